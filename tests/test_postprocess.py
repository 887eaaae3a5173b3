import os
import zlib

from image_builder import BS, image

from gneiss.plans import postprocess as P
from gneiss.sources import tree


def test_blobs_are_named_and_unpacked(spark, tmp_path):
    folder = tmp_path / "orphans"
    folder.mkdir()
    text = b"SELECT * FROM t WHERE x = 1"
    files = {"a.dat": b"\xff\xd8\xff\xe0" + bytes(9), "b.dat": bytes(99), "c.dat": b"fpmc" + (3).to_bytes(4, "little") + len(text).to_bytes(8, "little") + zlib.compress(text), "d.dat": b"fpmc" + (3).to_bytes(4, "little") + bytes(8) + b"?", "e.dat": bytes(range(1, 9))}
    for n, raw in files.items():
        (folder / n).write_bytes(raw)
    plan = P.blob_plan(tree.read_blobs(spark, str(folder)))
    got = {r.name: r.outcome for r in P.apply_blob_plan(plan, str(folder)).collect()}
    assert got == {"a.dat": "identified", "b.dat": "noise", "c.dat": "identified", "d.dat": "unrecoverable", "e.dat": "unknown"}
    left = sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, ns in os.walk(folder) for n in ns if not n.startswith("."))
    assert left == ["a.jpg", "c.sql", "unknown/e.dat", "unrecoverable/d.dat"] and (folder / "c.sql").read_bytes() == text


def test_fragments_and_decompression(spark, tmp_path):
    df = spark.createDataFrame([("inode_1_block_2.raw", bytearray(b"%PDF-1.4")), ("inode_3_block_4.raw", bytearray(b"\x01\x02"))], "name string, content binary")
    assert sorted(r.new_name for r in P.fragment_plan(df).collect()) == ["inode_1_block_2.pdf", "inode_3_block_4.raw"]
    (tmp_path / "x").write_bytes(bytes([100, 0, 0, 0, 7, 0, 0, 0]) + bytes(92) + bytes.fromhex("E448454C4C4F06"))
    (tmp_path / "y").write_bytes(b"plain")
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {r.name: r.how for r in P.decompress_in_place(str(tmp_path), names).collect()} == {"x": "decoded", "y": "plain"}
    assert (tmp_path / "x").read_bytes() == b"HELLO"


def test_expanded_copies_and_dumps(spark, tmp_path):
    img = str(tmp_path / "i.img")
    with open(img, "wb") as f:
        f.write(image({5: b"A" * BS, 6: b"B" * BS}))
    rows = spark.createDataFrame([(1, "d/a_EXPANDED", 10, [(0, 5, BS), (BS, 6, BS)]), (2, "b_EXPANDED", BS, [(0, 5, BS), (BS, 9, BS)])], "inode_id long, path string, size long, parts array<struct<logical:long,physical:long,length:long>>")
    assert {r.inode_id: r.discarded for r in P.expanded_copies(rows, img, str(tmp_path), BS).collect()} == {1: False, 2: True}
    assert (tmp_path / "d/a_EXPANDED").read_bytes() == b"A" * BS + b"B" * BS and not (tmp_path / "b_EXPANDED").exists()
    assert P.space_needed(rows, str(tmp_path))["needed"] == 10 + BS and not P.first_bytes(img)
    results = spark.createDataFrame([(1, "p", "failed: no space", 0), (2, "q", "ok", 5)], "inode_id long, path string, status string, bytes_written long")
    P.error_log(results, str(tmp_path / "log"))
    P.dump(results, str(tmp_path / "ids"), "inode_id")
    P.dump(results, str(tmp_path / "json"))
    P.write_tree_stats(tree.read_tree(spark, str(tmp_path / "d")), str(tmp_path / "tsv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["ERROR failed: no space  inode 1  p"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1", "2"] and spark.read.json(str(tmp_path / "json")).count() == 2
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first().path == "a_EXPANDED"
