import os
import random
import zlib

import numpy as np
import pytest
from image_builder import BS, drec, extent, image, inode, leaf, superblock, xattr
from pyspark.sql import functions as F

from gneiss.functions import codecs, crypto
from gneiss.operators import hierarchy, relations
from gneiss.plans import checkpoint, recover
from gneiss.sources import blocks, decode, geometry, tree

FILE, DIR, LINK = 0o100644, 0o040755, 0o120777


def sample(extra=()):
    text = b"The quick brown fox.\n" * 300
    packed = zlib.compress(b"compressed " * 40)
    records = [
        drec(2, "a", 16, True), inode(16, 2, DIR),
        drec(16, "b.txt", 17), inode(17, 16, FILE, len(text)), extent(17, 0, 40, 8192),
        drec(2, "link", 18), inode(18, 2, LINK, 0, "a/b.txt"),
        drec(16, "z.bin", 19), inode(19, 16, FILE, 0, flags=0x20), xattr(19, "com.apple.decmpfs", b"fpmc"[::-1] + (3).to_bytes(4, "little") + (440).to_bytes(8, "little") + packed),
        inode(20, 99, FILE, 5), extent(20, 0, 42, 4096),
    ]
    return {0: superblock(), 3: leaf(records, root=True), 40: text[:4096], 41: text[4096:], 42: b"lost!", **dict(extra)}, text


def put(tmp_path, parts, **how):
    path = str(tmp_path / "disk.img")
    with open(path, "wb") as f:
        f.write(image(parts, **how))
    return path


def test_source_skips_empty_blocks_and_splits(spark, tmp_path):
    path = put(tmp_path, sample()[0])
    df = blocks.read_blocks(spark, path, BS, stretchBytes=8 * BS)
    assert sorted(r.block_num for r in df.select("block_num").collect()) == [0, 3, 40, 41, 42]
    assert df.rdd.getNumPartitions() == 8
    assert blocks.read_blocks(spark, path, BS, keep_empty=True).count() == 64
    assert blocks.read_blocks(spark, path, BS, firstBlock=40, lastBlock=42).count() == 2
    with pytest.raises(Exception, match="power of two"):
        blocks.read_blocks(spark, path, 1000).count()


def test_full_recovery_and_resume(spark, tmp_path):
    parts, text = sample()
    path, out = put(tmp_path, parts), str(tmp_path / "out")
    got = {r.path: (r.status, r.bytes_written) for r in recover.recover(spark, recover.Options(path, out, deleted=True)).collect()}
    assert got == {"files/a/b.txt": ("ok", len(text)), "files/link": ("link", 0), "files/a/z.bin": ("ok", 440), "orphans/file_20.dat": ("ok", 5)}
    assert open(f"{out}/files/a/b.txt", "rb").read() == text
    assert open(f"{out}/files/a/z.bin", "rb").read() == b"compressed " * 40
    assert open(f"{out}/orphans/file_20.dat", "rb").read() == b"lost!"
    assert os.readlink(f"{out}/files/link") == "a/b.txt"
    assert int(os.stat(f"{out}/files/a/b.txt").st_mtime) == 1_600_000_000
    assert "| ok |" in open(f"{out}/reports/recovery_summary.md").read()
    assert recover.recover(spark, recover.Options(path, out), run=2).count() == 0  # all done
    again = recover.recover(spark, recover.Options(path, out, re_extract=True, extensions=["TXT"]), run=3).collect()
    assert [r.path for r in again] == ["files/a/b.txt"]
    assert recover.recover(spark, recover.Options(path, str(tmp_path / "scan"), scan_only=True)) is None
    few = recover.recover(spark, recover.Options(path, str(tmp_path / "p"), pilot="z.b", resume=False)).collect()
    assert [r.path for r in few] == ["files/a/z.bin"]
    with pytest.raises(ValueError):
        recover.recover(spark, recover.Options(path, out, re_extract=True, scan_only=True))


def test_conflicting_versions(spark, tmp_path):
    one = leaf([drec(5, "old", 30), inode(30, 2, FILE, 10), extent(30, 0, 41, 4096)], xid=4)
    two = leaf([drec(2, "new", 30), inode(30, 2, FILE, 20), extent(30, 0, 42, 4096), extent(30, 0, 9999, 4096)], xid=8)
    path = put(tmp_path, {1: one, 2: two, 41: b"A", 42: b"B" * 20})
    e = decode.decode_entries(blocks.read_blocks(spark, path), BS)
    latest = relations.latest_extents(relations.plausible_extents(decode.extent_facts(e), 64, BS, 64 * BS))
    assert [(r.inode_id, r.physical) for r in latest.collect()] == [(30, 42)]
    names = decode.directory_entries(e)
    kept = relations.one_entry_per_file(names, spark.createDataFrame([(2,)], "inode_id long")).collect()
    assert [(r.name, r.parent_inode) for r in kept] == [("new", 2)]
    (r,) = recover.merge_inodes(decode.inode_facts(e), decode.attribute_facts(e), 64 * BS).collect()
    assert r.size == 20 and not r.is_dir
    assert decode.decode_entries(blocks.read_blocks(spark, path), BS, min_xid=5).select("block_num").distinct().collect()[0].block_num == 2
    assert {(r.block_num, r.xid) for r in decode.node_transactions(blocks.read_blocks(spark, path)).collect()} == {(1, 4), (2, 8)}


def test_damaged_table_is_scanned(spark, tmp_path):
    records = [drec(2, f"name{i:03d}", 100 + i) for i in range(8)]
    path = put(tmp_path, {1: leaf(records, break_table=True)})
    got = decode.decode_entries(blocks.read_blocks(spark, path), BS).collect()
    assert {r.key_type for r in got} == {9} and {r.source for r in got} <= {"partial", "guess"}
    found = [decode.parse_entry(r.key_id, bytes(r.key), bytes(r.val)) for r in got if r.source == "partial"]
    assert {f[2] for f in found if f} >= {f"name{i:03d}" for i in range(0, 8, 2)}


def test_fixed_and_overlapping_entries():
    raw = leaf([((7 | 3 << 60).to_bytes(8, "little"), bytes(16))], fixed=True)
    assert [(k, i, s) for k, i, _, _, s in decode.node_entries(raw)] == [(3, 7, "table")]
    raw = bytearray(leaf([inode(5, 2, FILE)]))
    raw[60:62] = (4040).to_bytes(2, "little")  # the value would begin in the key area
    assert not list(decode.node_entries(bytes(raw)))
    assert not list(decode.node_entries(bytes(BS)))


def test_paths_limits(spark):
    chain = [(i - 1 if i > 3 else 2, i, f"n{i}") for i in range(3, 105)]  # 102 parts
    rows = [*chain, (9001, 9000, "x"), (9000, 9001, "y"), (12345, 9002, "dangling"), (2, 2, "root")]
    df = spark.createDataFrame(rows, "parent_inode long, file_inode long, name string")
    got = {r.inode_id: r.depth for r in hierarchy.resolve_paths(df).collect()}
    assert got == {i: i - 2 for i in range(3, 103)}
    short = df.where("file_inode < 50")
    a = sorted(map(tuple, hierarchy.resolve_paths(short).collect()))
    assert a == sorted(map(tuple, hierarchy.resolve_paths_sql(short).collect())) and len(a) == 47


def password_blob(salt, rounds, wrapped, damaged=False):
    """A key record as nested DER: version, check value, then flags, wrapped key, rounds and salt."""
    field = lambda tag, body: bytes((tag, len(body))) + body
    inner = field(0x80, b"\0") + field(0x82, bytes(8)) + field(0x83, wrapped) + field(0x84, rounds) + field(0x85, salt)
    body = field(0x80, b"\0") + field(0x81, bytes(32)) + field(0xA3, inner)
    return b"\x30\x82" + (b"\x85\x10" if damaged else len(body).to_bytes(2, "big")) + body


def test_key_records_are_read_by_their_structure():
    rng = random.Random(2)
    for i in range(3000):
        salt, rounds, wrapped = rng.randbytes(16), rng.randint(1, 1 << 24).to_bytes(4, "big"), rng.randbytes(40)
        if i % 3 == 0:  # what a search for tags would take for rounds or a salt
            wrapped = wrapped[:7] + b"\x84\x01\x05\x85\x10" + wrapped[12:]
        want = crypto.PasswordInfo(salt, int.from_bytes(rounds, "big"), wrapped)
        assert crypto.password_infos(password_blob(salt, rounds, wrapped)) == [want]
        assert crypto.wrapped_keys(password_blob(salt, rounds, wrapped)) == [wrapped]
        if i % 50 == 0:
            assert want in crypto.password_infos(password_blob(salt, rounds, wrapped, damaged=True))
    for blob in (b"", b"\x30", b"\x30\x80", b"\x83\x28abc", bytes(100), b"\x30\x84\xff\xff\xff\xff", b"\xff" * 50):
        assert crypto.password_infos(blob) == [] and crypto.wrapped_keys(blob) == []


def test_volume_uuid(tmp_path):
    volume = bytearray(BS)
    volume[24:28], volume[264:280] = (0x80000003).to_bytes(4, "little"), bytes(range(16))
    path = put(tmp_path, {40: bytes(volume), 50: bytes(volume)})
    assert geometry.volume_uuid(path, geometry.Geometry()) == bytes(range(16))
    assert geometry.volume_uuid(put(tmp_path, {20: bytes(volume)}), geometry.Geometry()) is None


@pytest.mark.parametrize("seed", range(3))
def test_encrypted_image(spark, tmp_path, seed):
    rng = random.Random(seed)
    vek, kek, salt, uuid, vol = rng.randbytes(32), rng.randbytes(32), rng.randbytes(16), rng.randbytes(16), rng.randbytes(16)
    derived = crypto.derive_key("secret", salt, 10)
    der = password_blob(salt, b"\x0a", crypto.wrap_key(kek, derived), damaged=seed == 1)
    entry = lambda u, tag, data: (u + tag.to_bytes(2, "little") + len(data).to_bytes(2, "little") + bytes(4) + data).ljust(24 + len(data) + 15 & ~15, b"\0")
    bag = lambda *e: (bytes(24) + (0x6B657973).to_bytes(4, "little") + bytes(6) + len(e).to_bytes(2, "little") + bytes(12) + b"".join(e)).ljust(BS, b"\0")
    per = BS // 512
    lock = crypto.SectorCipher(uuid, uuid).encrypt(bag(entry(vol, 2, b"\x83\x28" + crypto.wrap_key(vek, kek)), entry(vol, 3, (11).to_bytes(8, "little"))), 10 * per)
    inner = crypto.SectorCipher(vol, vol).encrypt(bag(entry(vol, 3, der)), 11 * per)
    c = crypto.SectorCipher(vek[:16], vek[16:])
    parts, text = sample()
    sealed = {n: c.encrypt(raw.ljust(BS, b"\0"), n * per) for n, raw in parts.items() if n}
    path = put(tmp_path, {0: superblock(uuid, 10), 10: lock, 11: inner, **sealed})
    if seed:
        got = {r.path: r.status for r in recover.recover(spark, recover.Options(path, str(tmp_path / "o"), password="secret")).collect()}
        assert got["files/a/b.txt"] == "ok"
        return
    with pytest.raises(ValueError, match="password is needed"):
        recover.recover(spark, recover.Options(path, str(tmp_path / "o")))
    with pytest.raises(ValueError, match="does not open"):
        recover.recover(spark, recover.Options(path, str(tmp_path / "o"), password="wrong"))
    got = {r.path: r.status for r in recover.recover(spark, recover.Options(path, str(tmp_path / "o"), password="secret")).collect()}
    assert got["files/a/b.txt"] == "ok" and open(tmp_path / "o/files/a/b.txt", "rb").read() == text


def test_node_tests():
    good = bytearray(leaf([drec(2, "x", 5)]))
    assert geometry.looks_strict(good)
    for flags, ok in ((0x42, True), (0x8001, True), (0, False), (8, False), (0xFFF8, False)):
        good[32:34] = flags.to_bytes(2, "little")
        assert geometry.looks_strict(good) == geometry.looks_partial(good) == ok
    rng = random.Random(3)
    noise = [bytes(rng.randbytes(BS)) for _ in range(200)] + [b"text " * 819 + b"x", bytes(BS)]
    rows = np.frombuffer(b"".join(noise), np.uint8).reshape(-1, BS)
    assert decode.strict_rows(rows).tolist() == [geometry.looks_strict(b) for b in noise]
    assert decode.lenient_rows(rows).tolist() == [geometry.looks_partial(b) for b in noise]
    edge = bytearray(BS)
    edge[32], edge[42:44] = 2, (4000).to_bytes(2, "little")
    assert not geometry.looks_partial(edge)  # no room for the key area


def test_distributed_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geometry, "HEAD_BYTES", 64 * BS)
    monkeypatch.setattr(geometry, "CHUNK_BYTES", 3 * BS + 7)
    path = put(tmp_path, {100: superblock(blocks=5), 130: superblock(blocks=9), 150: bytes(32) + b"APSB" + bytes(20) + (8).to_bytes(8, "little")}, blocks=256)
    assert geometry.find_geometry(path).found_by == "default"
    g = geometry.find_geometry(path, spark=spark)
    assert (g.partition_offset, g.found_by, g.case_sensitive) == (100 * BS, "first superblock", True)
    assert sorted(r.start for r in geometry.magic_hits(spark, path, b"NXSB", chunk=5 * BS + 1).collect()) == [100 * BS, 130 * BS]


def test_batches_open_like_blocks():
    rng = random.Random(4)
    c = crypto.SectorCipher(rng.randbytes(16), rng.randbytes(16))
    raw = [rng.randbytes(BS) for _ in range(5)]
    sectors = np.array([8, 800, 16, 0, 1 << 33], np.int64)
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BS)
    assert [r.tobytes() for r in c.decrypt_blocks(rows, sectors, step=2)] == [c.decrypt(b, int(n)) for b, n in zip(raw, sectors)]


def test_geometry(spark, tmp_path):
    def find(raw, **how):
        p = tmp_path / "g.img"
        p.write_bytes(raw)
        return geometry.find_geometry(str(p), **how)

    plain = image({0: superblock()})
    assert (g := find(plain)).partition_offset == 0 and g.found_by == "first superblock"
    assert find(bytes(512 * 20) + plain).partition_offset == 512 * 20
    assert find(plain, superblock_lba=8).partition_offset == 0
    gpt = bytearray(bytes(40 * 512))
    gpt[512:520] = b"EFI PART"
    gpt[512 + 72 : 512 + 80] = (2).to_bytes(8, "little")
    gpt[512 + 84 : 512 + 88] = (128).to_bytes(4, "little")
    gpt[1024:1028] = b"\xef\x57\x34\x7c"
    gpt[1024 + 32 : 1024 + 40] = (40).to_bytes(8, "little")
    g = find(bytes(gpt) + plain)
    assert g.partition_offset == 40 * 512 and g.found_by == "partition table"
    assert find(bytes(gpt) + bytes(BS) + plain[BS:] + superblock()).partition_offset == 40 * 512
    node = find(image({2: leaf([drec(2, "x", 5)])}))
    assert node.found_by == "tree node" and node.block_size == 4096
    assert find(b"") == geometry.Geometry() and find(bytes(10_000)).found_by == "default"
    (tmp_path / "s.img").write_bytes(plain + superblock(blocks=999))
    assert [s["block_count"] for s in geometry.describe_superblocks(spark, str(tmp_path / "s.img"))] == [999, 64]


def test_checkpoint_round_trip(spark, tmp_path):
    t = {"a": spark.createDataFrame([(42, "python3.12")], "inode_id long, symlink_target string")}
    folder = str(tmp_path / "cp")
    assert checkpoint.load_scan(spark, folder, ["a"]) is None
    checkpoint.save_scan(folder, t, {"block_size": 4096, "partition_offset": 0x100000, "encrypted": True, "case_sensitive": False})
    m, back = checkpoint.load_scan(spark, folder, ["a"])
    assert (m["partition_offset"], m["encrypted"], m["complete"]) == (0x100000, True, True) and back["a"].collect() == t["a"].collect()
    checkpoint.save_scan(folder, t, {}, complete=False)
    assert checkpoint.load_scan(spark, folder, ["a"]) is None
    spark.createDataFrame([(99, True, None, 1, 1, False, None)], checkpoint.MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    assert checkpoint.load_scan(spark, folder, ["a"]) is None
    assert checkpoint.load_done(spark, folder).count() == 0
    ids = spark.createDataFrame([(1001,), (2002,), (2002,)], "inode_id long")
    checkpoint.append_done(folder, ids, 1)
    checkpoint.append_done(folder, ids.where("inode_id = 1001"), 2)
    assert sorted(r.inode_id for r in checkpoint.load_done(spark, folder).collect()) == [1001, 2002]
    assert checkpoint.describe(spark, folder, ["a"]).collect()[0].rows == 1


def test_blobs_and_trees(spark, tmp_path):
    z = zlib.compress(b"#!/bin/sh\necho hello\n")
    contents = {"a.dat": b"\xff\xd8\xff\xe0" + bytes(20), "b.dat": bytes(300), "c.dat": b"fpmc" + (3).to_bytes(4, "little") + (21).to_bytes(8, "little") + z, "d.dat": b"fpmc" + (3).to_bytes(4, "little") + bytes(8) + b"xx", "e.dat": bytes(range(1, 9)), "f.dat": b"\x89\x01\x02" * 20 + b"<html><body>text of it</body>", "g.txt": b"no blob"}
    folder = tmp_path / "blobs"
    folder.mkdir()
    for n, raw in contents.items():
        (folder / n).write_bytes(raw)
    got = {r.name: (r.outcome, r.extension) for r in codecs.identify_blobs(tree.read_blobs(spark, str(folder))).collect()}
    assert got == {"a.dat": ("identified", "jpg"), "b.dat": ("noise", None), "c.dat": ("identified", "sh"), "d.dat": ("unrecoverable", None), "e.dat": ("unknown", None), "f.dat": ("identified", "html")}
    os.symlink("a.dat", folder / "l")
    t = {r.path: r for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert t["blobs"].type == "D" and t["blobs/l"].target == "a.dat" and t["blobs/g.txt"].size == 7
    assert tree.manifest_lines(tree.read_tree(spark, str(folder))).where(F.col("value").endswith("  g.txt")).count() == 1


def test_command_line_errors(spark, tmp_path):
    assert recover.main([str(tmp_path / "none.img")]) == 1
    assert recover.size_argument("1.5k") == 1536 and recover.size_argument("-3") == 0 and recover.size_argument("7q") == 7


def test_what_follows_the_writing(spark, tmp_path):
    """Names by signature, names of orphans, times of folders, copies of files that are cut short, steps that are remembered."""
    jpeg, stamp = b"\xff\xd8\xff\xe0" + bytes(50), 1_600_000_000 * 10**9
    records = [
        drec(2, "d", 16, True), inode(16, 2, DIR, mtime=stamp),
        drec(16, "photo.txt", 17), inode(17, 16, FILE, len(jpeg)), extent(17, 0, 40, 4096),
        drec(16, "short.bin", 18), inode(18, 16, FILE, 100), extent(18, 0, 41, 4096 * 12),
        drec(16, "late.txt", 19), inode(19, 16, FILE, 3, mtime=9 * 10**18), extent(19, 0, 42, 4096),
        inode(20, 99, FILE, len(jpeg)), extent(20, 0, 40, 4096),
        inode(21, 99, FILE, 8), extent(21, 0, 56, 4096),
    ]
    path = put(tmp_path, {0: superblock(), 3: leaf(records, root=True), 40: jpeg, 41: b"s" * 4096, 42: b"abc" + b"t" * 4093, 56: bytes(range(1, 9))})
    out = tmp_path / "out"
    options = recover.Options(path, str(out), name_orphans=True, expand=True, chunk_files=2)
    got = {r.path: r.status for r in recover.recover(spark, options).collect()}
    assert set(got.values()) == {"ok"} and len(got) == 5
    files = sorted(os.path.relpath(os.path.join(d, n), out) for d, _, ns in os.walk(out) for n in ns if "/reports" not in d and "/checkpoint" not in d and not n.startswith("."))
    assert "files/d/photo.jpg" in files and "files/d/photo.txt" not in files
    assert "orphans/file_20.jpg" in files and "orphans/unknown/file_21.dat" in files
    (copy,) = [f for f in files if "EXPANDED" in f]
    raw = (out / copy).read_bytes()
    assert len(raw) == 4096 * 12 and raw[:4096] == b"s" * 4096 and (out / "files/d/short.bin").read_bytes() == b"s" * 100
    assert int(os.stat(out / "files/d").st_mtime) == 1_600_000_000 and os.stat(out / "files/d").st_mode & 0o777 == 0o755
    assert os.stat(out / "files/d/late.txt").st_mtime < 5 * 10**9  # a time far ahead is not restored
    assert {r.inode_id for r in checkpoint.load_done(spark, str(out / "checkpoint")).collect()} == {17, 18, 19, 20, 21}
    assert recover.recover(spark, options, run=2).count() == 0
    assert "Possibly truncated" in (out / "reports/recovery_summary.md").read_text()


def test_long_blobs_are_decoded_whole_before_anything_goes(spark, tmp_path):
    from gneiss.plans import postprocess

    text = b"".join(b"line %d of a long text that is compressed\n" % (i * 7919 % 10007) for i in range(30_000))
    stream = b"".join(bytes((0xF0, 255)) + text[a : a + 271] if len(text) - a >= 271 else b"" for a in range(0, len(text), 271))
    body = text[: len(text) // 271 * 271]
    blobs = {"zero.dat": bytes(300_000) + b"data after it", "zlib.dat": b"fpmc" + (3).to_bytes(4, "little") + len(text).to_bytes(8, "little") + zlib.compress(text, 0), "lzvn.dat": b"fpmc" + (7).to_bytes(4, "little") + len(body).to_bytes(8, "little") + stream + b"\x06", "gone.dat": bytes(300_000)}
    assert min(len(blobs["lzvn.dat"]), len(blobs["zlib.dat"])) > 262_144
    for n, raw in blobs.items():
        (tmp_path / n).write_bytes(raw)
    done = {r.name: r.outcome for r in postprocess.apply_blob_plan(postprocess.blob_plan(tree.read_blobs(spark, str(tmp_path))), str(tmp_path)).collect()}
    assert done["gone.dat"] == "noise" and done["zero.dat"] != "noise"
    left = [(d, n) for d, _, ns in os.walk(tmp_path) for n in ns if not n.startswith(".")]
    contents = {n.split(".")[0]: open(os.path.join(d, n), "rb").read() for d, n in left}
    assert contents == {"zero": blobs["zero.dat"], "zlib": text, "lzvn": body}
