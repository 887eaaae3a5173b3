from gneiss.streaming import blobs


def test_each_blob_once(spark, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.dat").write_bytes(b"%PDF-1.4 ...")
    (folder / "b.dat").write_bytes(bytes(100))
    blobs.start(spark, str(folder), out, cp).awaitTermination(60)
    (folder / "c.dat").write_bytes(b"#!/bin/sh\n")
    blobs.start(spark, str(folder), out, cp).awaitTermination(60)
    got = sorted((r.name, r.outcome, r.extension) for r in spark.read.parquet(out).collect())
    assert got == [("a.dat", "identified", "pdf"), ("b.dat", "noise", None), ("c.dat", "identified", "sh")]
