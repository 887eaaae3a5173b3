"""After recovery: naming of recovered blobs, expanded copies, space needs, statistics and dumps."""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.functions.classify import classify, correct_extension
from gneiss.functions.codecs import identify_blobs, unpack_blob
from gneiss.functions.crypto import SectorCipher
from gneiss.operators.assemble import replace_file, stream_file
from gneiss.sources.blocks import read_at


def blob_plan(blobs: DataFrame) -> DataFrame:
    """What becomes of each recovered blob: ``name, outcome, new_name``; noise goes, unknown formats move aside."""
    found = identify_blobs(blobs)
    stem = F.regexp_replace("name", r"\.dat$", "")
    new = F.when(F.col("outcome") == "identified", F.concat(stem, F.lit("."), F.col("extension"))).when(F.col("outcome") == "unknown", F.concat(F.lit("unknown/"), "name")).when(F.col("outcome") == "unrecoverable", F.concat(F.lit("unrecoverable/"), "name"))
    return found.select("name", "outcome", new.alias("new_name"), F.when(F.col("how") == "decoded", F.col("decoded")).alias("content"))


def apply_blob_plan(plan: DataFrame, folder: str) -> DataFrame:
    """Write decoded content, rename or remove the files; one row with the outcome of each. Safe to repeat."""

    def run(batches):
        for batch in batches:
            names, outcomes = [], []
            for r in batch.to_pylist():
                old = os.path.join(folder, r["name"])
                new = os.path.join(folder, r["new_name"]) if r["new_name"] else None
                if new:
                    os.makedirs(os.path.dirname(new), exist_ok=True)
                if new and r["content"] is not None:
                    replace_file(new, r["content"])
                    if new != old and os.path.exists(old):
                        os.remove(old)
                elif new and os.path.exists(old):
                    os.replace(old, new)
                elif not new and os.path.exists(old):
                    os.remove(old)
                names.append(r["name"])
                outcomes.append(r["outcome"])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(outcomes, pa.string())], names=["name", "outcome"])

    return plan.mapInArrow(run, "name string, outcome string")


def correct_names(written_files: DataFrame, folder: str) -> DataFrame:
    """Give files with a JPEG or PNG signature that extension: ``inode_id, path, new_path`` of those renamed.

    ``written_files``: inode_id, path. A name that is taken already stays as it is. Safe to repeat.
    """

    def head(batches):
        for batch in batches:
            heads = []
            for path in batch.column(1).to_pylist():
                try:
                    with open(os.path.join(folder, path), "rb") as f:
                        heads.append(f.read(9))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["inode_id", "path", "head"])

    def rename(batches):
        for batch in batches:
            done = []
            for old, new in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = os.path.join(folder, old), os.path.join(folder, new)
                if os.path.exists(a) and not os.path.lexists(b):
                    os.replace(a, b)
                done.append(os.path.exists(b) and not os.path.exists(a))
            yield batch.filter(pa.array(done, pa.bool_()))

    looked = written_files.select("inode_id", "path").mapInArrow(head, "inode_id long, path string, head binary")
    wanted = looked.select("inode_id", "path", correct_extension(F.col("path"), F.col("head")).alias("new_path")).where("new_path <> path")
    return wanted.mapInArrow(rename, "inode_id long, path string, new_path string")


def fragment_plan(fragments: DataFrame) -> DataFrame:
    """New names of deleted fragments by the class of their first 512 bytes; others keep theirs."""
    ext = classify(F.substring("content", 1, 512))
    return fragments.select("name", F.when(ext.isNotNull(), F.concat(F.regexp_replace("name", r"\.raw$", ""), F.lit("."), ext)).otherwise(F.col("name")).alias("new_name"))


def decompress_in_place(folder: str, names: DataFrame) -> DataFrame:
    """Replace blobs that have a compression header by what they decode to: ``name, how``."""

    def run(batches):
        for batch in batches:
            hows = []
            for n in batch.column(0).to_pylist():
                with open(os.path.join(folder, n), "rb") as f:
                    how, content = unpack_blob(f.read(), late=True)
                if how == "decoded":
                    replace_file(os.path.join(folder, n), content)
                hows.append(how)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hows, pa.string())], names=["name", "how"])

    return names.select("name").mapInArrow(run, "name string, how string")


def expanded_copies(rows: DataFrame, image: str, out_dir: str, block_size: int, partition_offset: int = 0, volume_key: bytes | None = None) -> DataFrame:
    """For files that may be cut short, a copy with all that the extents hold: ``inode_id, path, discarded``.

    ``rows``: inode_id, path (of the copy), size and parts. A copy with nothing but zeros beyond the recorded size
    is not written. Copies are written extent by extent and looked at in pieces, so their size is not bounded by memory.
    """

    def only_zeros(path: str, begin: int) -> bool:
        with open(path, "rb") as f:
            f.seek(begin)
            while piece := f.read(1 << 24):
                if piece.count(0) < len(piece):
                    return False
        return True

    def run(batches):
        cipher = SectorCipher(volume_key[:16], volume_key[16:]) if volume_key else None
        fd = os.open(image, os.O_RDONLY)
        try:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    parts = [(p["logical"], p["physical"], p["length"]) for p in r["parts"] or []]
                    target = os.path.join(out_dir, r["path"])
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    stream_file(fd, parts, max((a + n for a, _, n in parts), default=0), target, block_size, partition_offset, cipher)
                    empty = only_zeros(target, r["size"])
                    if empty:
                        os.remove(target)
                    out.append((r["inode_id"], r["path"], empty))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.bool_()))], names=["inode_id", "path", "discarded"])
        finally:
            os.close(fd)

    return rows.select("inode_id", "path", "size", "parts").mapInArrow(run, "inode_id long, path string, discarded boolean")


def space_needed(files: DataFrame, folder: str) -> dict:
    """Bytes that are still to be written and bytes that are free where they go."""
    need = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    free = shutil.disk_usage(folder).free
    return {"needed": int(need), "free": free, "fits": need <= free}


def write_tree_stats(tree: DataFrame, path: str) -> None:
    """The relation of ``read_tree`` as tab-separated text with a header."""
    tree.orderBy("path").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def dump(df: DataFrame, path: str, ids_only: str | None = None) -> None:
    """A checkpoint table as JSON lines, or one of its id columns as text."""
    if ids_only:
        df.select(F.col(ids_only).cast("string")).distinct().orderBy(ids_only).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def error_log(results: DataFrame, path: str, most: int = 1000) -> None:
    """One line for each failure, ``most`` at most, as error collectors keep them."""
    bad = results.where(F.col("status").startswith("failed") | (F.col("status") == "not decompressed"))
    bad.orderBy("path").limit(most).select(F.concat(F.lit("ERROR "), "status", F.lit("  inode "), F.col("inode_id").cast("string"), F.lit("  "), "path")).write.mode("overwrite").text(path)


def first_bytes(path: str, size: int = 64 * 1024 * 1024) -> bool:
    """Whether a superblock magic stands in the first bytes of an image; only a hint."""
    fd = os.open(path, os.O_RDONLY)
    try:
        have = min(size, os.fstat(fd).st_size)
        raw = read_at(fd, have, 0) if have else b""
        return b"NXSB" in (raw or b"")
    finally:
        os.close(fd)
