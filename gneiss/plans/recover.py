"""Recovery of an image, end to end: scan, relations, paths, work list, files, reports; a command line on top."""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions import crypto, scalars as X
from gneiss.operators import assemble, hierarchy, relations as R, worklist as W
from gneiss.sources import blocks, decode, geometry, tree
from gneiss.storage import written

from . import checkpoint, postprocess, reports

TABLES = ["entries", "inodes", "extents", "paths"]


@dataclass
class Options:
    image: str
    out: str
    password: str | None = None
    resume: bool = True
    scan_only: bool = False
    re_extract: bool = False
    deleted: bool = False
    extensions: list[str] = field(default_factory=list)
    pilot: str | None = None
    min_size: int = 0
    max_size: int = W.DEFAULT_MAX_SIZE
    superblock_lba: int = 0
    min_xid: int = 0
    metadata: bool = True
    compression: bool = True
    name_orphans: bool = False
    expand: bool = False
    chunk_files: int = 50_000

    def check(self) -> None:
        if self.re_extract and (not self.resume or self.scan_only):
            raise ValueError("re-extract needs the saved scan: it goes with neither no-resume nor scan-only")


def scan(spark: SparkSession, o: Options, g: geometry.Geometry, key: bytes | None) -> dict[str, DataFrame]:
    """The relations of an image: one entry per file, merged inodes, latest extents, paths."""
    size = os.stat(o.image).st_size - g.partition_offset
    raw = blocks.read_blocks(spark, o.image, g.block_size, g.partition_offset)
    entries = written(decode.decode_entries(raw, g.block_size, key, o.min_xid))
    found = written(R.plausible_extents(decode.extent_facts(entries), size // g.block_size, g.block_size, size))
    extents = R.latest_extents(found)
    inodes = merge_inodes(decode.inode_facts(entries), decode.attribute_facts(entries), size)
    names = decode.directory_entries(entries)
    single = written(R.one_entry_per_file(names, R.known_directories(inodes, names)))
    paths = hierarchy.resolve_paths(single.where("name <> ''"))
    clean = paths.withColumn("path", X.sanitize_path(F.col("path")))
    return {"entries": single, "inodes": written(inodes), "extents": extents, "paths": clean}


def merge_inodes(facts: DataFrame, attributes: DataFrame, partition_bytes: int) -> DataFrame:
    """One row per inode from the last fact that sets each field; inline compressed data marks a file as compressed."""
    both = facts.unionByName(attributes, allowMissingColumns=True)
    own = F.col("mode").isNotNull() | F.col("parent_id").isNotNull()
    always = {c: own for c in facts.columns if c not in ("inode_id", "block_num", "ord", "default_crypto_id", "symlink_target", "is_compressed")}
    set_once = {"default_crypto_id": F.col("default_crypto_id") != 0, "symlink_target": F.col("symlink_target").isNotNull(), "link_attribute": F.col("link_attribute").isNotNull(), "is_compressed": own}
    packed = {c: F.col("compression_type").isNotNull() for c in ("compression_type", "uncompressed_size", "decmpfs")}
    one = R.merge_last(both, "inode_id", ["block_num", "ord"], always | set_once | packed)
    return one.withColumn("is_compressed", F.coalesce("is_compressed", F.lit(False)) | F.col("compression_type").isNotNull()).withColumn("symlink_target", F.coalesce("link_attribute", "symlink_target")).withColumn("is_dir", F.coalesce("is_dir", F.lit(False))).withColumn("size", R.clamp_sizes(F.coalesce("size", F.lit(0).cast("long")), partition_bytes)).drop("link_attribute")


def plan_files(tables: dict[str, DataFrame], done: DataFrame, o: Options) -> DataFrame:
    """Every file to write with its path below the output folder, after filters."""
    inodes, extents, paths, entries = tables["inodes"], tables["extents"], tables["paths"], tables["entries"]
    dirs = R.known_directories(inodes, entries)
    files = inodes.join(dirs, "inode_id", "left_anti")
    bare = W.is_garbage_name(F.col("path"))
    named = files.join(paths.select("inode_id", "path"), "inode_id").where(~bare)
    lost = W.orphans(files, extents, dirs, named.select("inode_id"))
    if o.extensions:
        named, lost = named.where(W.wanted_extensions(F.col("path"), o.extensions)), lost.limit(0)
    if o.pilot:
        named, lost = named.where(W.pilot(F.col("path"), o.pilot)), lost.limit(0)
    lost = lost.withColumn("path", F.concat(F.lit("orphans/file_"), F.col("inode_id").cast("string"), F.lit(".dat"))).withColumn("is_orphan", F.lit(True))
    named = named.withColumn("path", F.concat(F.lit("files/"), "path")).withColumn("is_orphan", F.lit(False))
    work = W.without_done(named.unionByName(lost), done)
    cover = R.coverage(extents)
    work = work.join(cover, "inode_id", "left").withColumn("recorded_size", F.col("size")).withColumn("size", assemble.expected_size(F.col("size"), F.col("coverage"), F.col("dense"), F.col("nonempty")))
    first = extents.groupBy("inode_id").agg(F.min_by("physical", F.struct("logical", "physical")).alias("first_phys"))
    placed = W.collision_names(work.join(first, "inode_id", "left")).withColumn("wanted_path", F.col("path")).withColumn("path", F.col("actual_path")).drop("actual_path", "first_phys", "held", "dense", "nonempty")
    return placed if o.compression else placed.withColumn("is_compressed", F.lit(False))


def unlock(o: Options, g: geometry.Geometry) -> bytes | None:
    """The volume key of an encrypted image, from its key bag and the password; None if it has no key bag."""
    if g.superblock is None:
        return None
    fd = os.open(o.image, os.O_RDONLY)
    try:
        head = blocks.read_at(fd, 4096, g.superblock) or b""
        uuid, address, count = head[72:88], geometry.u(head, 1296, 8), geometry.u(head, 1304, 8)
        if not address or not count:
            return None
        read = lambda n: blocks.read_at(fd, g.block_size, g.partition_offset + n * g.block_size)
        raw = read(address)
        bag = crypto.open_keybag(raw, address, uuid) if raw else None
        if bag is None:
            return None
        if o.password is None:
            raise ValueError("the image is encrypted: a password is needed")
        key = crypto.volume_key(bag, read, g.block_size, o.password, geometry.volume_uuid(o.image, g))
        if key is None:
            raise ValueError("the password does not open the volume")
        return key
    finally:
        os.close(fd)


def recover(spark: SparkSession, o: Options, run: int = 1) -> DataFrame | None:
    """Recover an image below ``o.out``; returns a row per file written, or None after a scan only."""
    o.check()
    state = os.path.join(o.out, "checkpoint")
    g = geometry.find_geometry(o.image, o.superblock_lba, spark)
    key = unlock(o, g)
    saved = checkpoint.load_scan(spark, state, TABLES) if o.resume else None
    if o.re_extract and saved is None:
        raise ValueError("re-extract needs a saved scan")
    if saved is None:
        tables = scan(spark, o, g, key)
        checkpoint.save_scan(state, tables, {"image": o.image, "block_size": g.block_size, "partition_offset": g.partition_offset, "encrypted": key is not None, "case_sensitive": g.case_sensitive})
        saved = checkpoint.load_scan(spark, state, TABLES)
    _, tables = saved
    if o.scan_only:
        return None
    done = checkpoint.load_done(spark, state) if o.resume and not o.re_extract else spark.createDataFrame([], "inode_id long")
    files = written(plan_files(tables, done, o))
    chunks = max(1, -(-files.count() // o.chunk_files))
    results = None
    for k in range(chunks):  # what a chunk has written is remembered, so a stopped run goes on there
        mine = files.where(F.pmod(F.xxhash64("inode_id"), F.lit(chunks)) == k) if chunks > 1 else files
        rows = assemble.gather(mine, tables["extents"])
        found = written(assemble.write_files(rows, o.image, o.out, g.block_size, g.partition_offset, key, o.min_size, o.max_size))
        checkpoint.append_done(state, found.where(~F.col("status").startswith("failed")), run, more=k > 0)
        results = found if results is None else results.unionByName(found)
    good = results.where("status = 'ok'").select("inode_id", "path")
    renamed = written(postprocess.correct_names(good.where(F.col("path").startswith("files/")), o.out))
    if o.expand:
        parts = tables["extents"].groupBy("inode_id").agg(F.array_sort(F.collect_list(F.struct("logical", "physical", "length"))).alias("parts"))
        short = R.possibly_truncated(R.coverage(tables["extents"]).join(tables["inodes"].select("inode_id", "size"), "inode_id"), g.block_size).select("inode_id", "size")
        plain = good.join(files.where(~F.col("is_compressed")).select("inode_id"), "inode_id", "left_semi")
        copies = plain.join(short, "inode_id").join(parts, "inode_id").withColumn("path", X.suffix_before_extension(F.col("path"), "_EXPANDED"))
        written(postprocess.expanded_copies(copies, o.image, o.out, g.block_size, g.partition_offset, key))
    if o.metadata:
        restore_all(o.out, tables, files, good, renamed)
    orphans = os.path.join(o.out, "orphans")
    if o.name_orphans and os.path.isdir(orphans) and any(n.endswith(".dat") for n in os.listdir(orphans)):
        written(postprocess.apply_blob_plan(postprocess.blob_plan(tree.read_blobs(spark, orphans)), orphans))
    if o.deleted:
        write_deleted(spark, o, g)
    moved = files.where("path <> wanted_path").select("inode_id", "wanted_path", "path")
    cut = R.possibly_truncated(R.coverage(tables["extents"]).join(tables["inodes"].select("inode_id", "size"), "inode_id"), g.block_size).select("inode_id", "size", "coverage")
    folder = os.path.join(o.out, "reports")
    reports.write_reports(results, folder, moved, cut)
    reports.write_file_list(results.select("path", F.col("bytes_written").alias("size")), os.path.join(folder, "file_list"))
    postprocess.error_log(results, os.path.join(folder, "errors"))
    return results


def restore_all(root: str, tables: dict[str, DataFrame], files: DataFrame, good: DataFrame, renamed: DataFrame) -> None:
    """Modes and valid times of written files, then of the directories above them."""
    now = int(time.time())
    facts = [F.when(X.valid_time(F.col(c), now), F.col(c)).alias(c) for c in ("mod_ns", "access_ns")]

    def restore(part) -> None:
        assemble.restore_metadata(root, [r.asDict() for r in part])

    mode = F.coalesce("mode", F.lit(0))
    kept = files.join(good.select("path"), "path").join(renamed.select("inode_id", "new_path"), "inode_id", "left")
    kept.select(F.coalesce("new_path", "path").alias("path"), X.safe_mode(mode, F.lit(False)).alias("safe_mode"), *facts).foreachPartition(restore)
    folders = tables["inodes"].where("is_dir").join(tables["paths"].select("inode_id", "path"), "inode_id")
    folders.select(F.concat(F.lit("files/"), "path").alias("path"), X.safe_mode(mode, F.lit(True)).alias("safe_mode"), *facts).foreachPartition(restore)


def write_deleted(spark: SparkSession, o: Options, g: geometry.Geometry) -> None:
    folder = os.path.join(o.out, "deleted")
    os.makedirs(folder, exist_ok=True)
    found = decode.deleted_inodes(blocks.read_blocks(spark, o.image, g.block_size, g.partition_offset), g.block_size)

    def write(part) -> None:
        for r in part:
            assemble.replace_file(os.path.join(folder, f"inode_{r.inode_id}_block_{r.block_num}.raw"), bytes(r.bytes))

    found.foreachPartition(write)


def size_argument(text: str) -> int:
    """``1.5G`` as bytes, the driver-side twin of the column function; what is no number is 0."""
    import re

    m = re.match(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z])?", text)
    return int(float(m[1]) * 1024 ** " KMGT".find((m[2] or " ").upper())) if m and (m[2] or " ").upper() in " KMGT" else int(float(m[1])) if m else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gneiss", description="Recover files from a damaged block image.")
    p.add_argument("image")
    p.add_argument("out", nargs="?")
    p.add_argument("--password")
    for flag in ("no-resume", "scan-only", "re-extract", "deleted", "skip-metadata", "no-compression", "keep-orphan-names", "no-expanded", "superblocks"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--filter-ext", default="")
    p.add_argument("--pilot")
    p.add_argument("--min-size", default="0")
    p.add_argument("--max-size", default="")
    p.add_argument("-b", "--block", type=int, default=0)
    p.add_argument("--min-xid", type=lambda s: int(s, 0), default=0)
    a, _ = p.parse_known_args(argv)
    o = Options(a.image, a.out or f"{a.image}_recovered", a.password, not a.no_resume, a.scan_only, a.re_extract, a.deleted, [e for e in a.filter_ext.split(",") if e], a.pilot, size_argument(a.min_size), size_argument(a.max_size) or W.DEFAULT_MAX_SIZE, a.block, a.min_xid, not a.skip_metadata, not a.no_compression, not a.keep_orphan_names, not a.no_expanded)
    spark = SparkSession.builder.appName("gneiss").getOrCreate()
    try:
        if a.superblocks:
            geometry.superblock_table(spark, o.image).orderBy(F.desc("block_count"), "offset").show(1000, truncate=False)
            return 0
        results = recover(spark, o)
        if results is not None:
            reports.summary(results).show(truncate=False)
    except (ValueError, OSError) as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
