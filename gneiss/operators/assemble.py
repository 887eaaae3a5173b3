"""File content from extents: blocks read in physical order, decrypted, cut to size, written or returned."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.functions.codecs import file_content
from gneiss.functions.crypto import SECTOR, SectorCipher
from gneiss.sources.blocks import read_at


def read_extents(fd: int, extents: list[tuple[int, int, int]], size: int | None, block_size: int, partition_offset: int, cipher: SectorCipher | None) -> bytes:
    """The bytes of (logical, physical, length) extents; holes and physical 0 are zeros; cut or filled to ``size``."""
    reach = max((a + n for a, _, n in extents), default=0)
    total = reach if size is None else size
    out = bytearray(total)
    for logical, physical, length in extents:
        n = min(length, total - logical)
        if n <= 0 or not physical:
            continue
        blocks = -(-n // block_size)
        raw = read_at(fd, blocks * block_size, partition_offset + physical * block_size)
        if raw is None:
            parts = [read_at(fd, block_size, partition_offset + (physical + i) * block_size) or bytes(block_size) for i in range(blocks)]
            raw = b"".join(parts)
        if cipher:
            raw = cipher.decrypt(raw, physical * (block_size // SECTOR))
        out[logical : logical + n] = raw[:n]
    return bytes(out)


def gather(files: DataFrame, extents: DataFrame) -> DataFrame:
    """One row per file with its extents in order, in the order of the image, one stretch of it per task.

    ``files``: inode_id, path, size, is_orphan and optional compression columns. Files without extents come last.
    """
    lists = extents.groupBy("inode_id").agg(F.array_sort(F.collect_list(F.struct("logical", "physical", "length"))).alias("parts"))
    rows = files.join(lists, "inode_id", "left").withColumn("first_phys", F.col("parts")[0]["physical"])
    return rows.repartitionByRange(F.col("first_phys").asc_nulls_last(), F.col("inode_id")).sortWithinPartitions(F.col("first_phys").asc_nulls_last(), "inode_id")


def expected_size(size, coverage, dense, nonempty):
    """How long the file is taken to be: its recorded size if that is known and the extents do not contradict it."""
    return F.when((size > 0) & (coverage.isNull() | dense | nonempty | (size <= coverage)), size).otherwise(F.coalesce(coverage, F.lit(0).cast("long")))


def write_files(rows: DataFrame, image: str, out_dir: str, block_size: int, partition_offset: int = 0, volume_key: bytes | None = None, min_size: int = 0, max_size: int = 50 * 1024**3, in_memory: int = 1 << 30) -> DataFrame:
    """Write every file below ``out_dir`` and return one row for each: ``inode_id, path, status, bytes_written``.

    Links become links, compressed files are unpacked, empty orphans are skipped, sizes outside the limits are
    reported. Files over ``in_memory`` bytes are written extent by extent. A file is written under a temporary
    name first and renamed, so a repeated task replaces what a lost one left.
    """
    names = ("inode_id", "path", "status", "bytes_written")

    def run(batches):
        cipher = SectorCipher(volume_key[:16], volume_key[16:]) if volume_key else None
        fd = os.open(image, os.O_RDONLY)
        try:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    target = os.path.join(out_dir, r["path"])
                    status, n = "ok", 0
                    parts = [(p["logical"], p["physical"], p["length"]) for p in r["parts"] or []]
                    try:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        if r.get("symlink_target"):
                            if os.path.lexists(target):
                                os.remove(target)
                            os.symlink(r["symlink_target"], target)
                            status = "link"
                        else:
                            size = r["size"]
                            if r.get("is_compressed"):
                                fork = read_extents(fd, parts, None, block_size, partition_offset, cipher) if parts else None
                                content = file_content(r["compression_type"] or 0, r["decmpfs"], fork, r["uncompressed_size"] or 0, size or 0)
                                status = "ok" if content is not None else "not decompressed"
                            elif (size or 0) > max_size or (size or 0) < min_size:
                                content, status = None, "above maximum size" if (size or 0) > max_size else "below minimum size"
                            elif (size or 0) > in_memory:
                                content = None
                                n = stream_file(fd, parts, size, target, block_size, partition_offset, cipher)
                            else:
                                content = read_extents(fd, parts, size if size else None, block_size, partition_offset, cipher)
                            if content is not None:
                                if not content and r["is_orphan"]:
                                    status = "empty orphan"
                                else:
                                    replace_file(target, content)
                                    n = len(content)
                    except OSError as e:
                        status = f"failed: {e.strerror}"
                    out.append((r["inode_id"], r["path"], status, n))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=list(names))
        finally:
            os.close(fd)

    return rows.mapInArrow(run, "inode_id long, path string, status string, bytes_written long")


def replace_file(target: str, content: bytes) -> None:
    part = f"{target}.part-{os.getpid()}"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, target)


def stream_file(fd: int, parts: list[tuple[int, int, int]], size: int, target: str, block_size: int, partition_offset: int, cipher: SectorCipher | None, step: int = 1 << 24) -> int:
    part = f"{target}.part-{os.getpid()}"
    with open(part, "wb") as f:
        for logical, physical, length in parts:
            n = min(length, size - logical)
            for at in range(0, n, step):
                raw = read_extents(fd, [(0, physical + at // block_size if physical else 0, min(step, n - at))], None, block_size, partition_offset, cipher)
                f.seek(logical + at)
                f.write(raw)
        f.truncate(size)
    os.replace(part, target)
    return size


def restore_metadata(root: str, rows: list[dict]) -> int:
    """Set modes and times of written files and directories, the deepest first; returns how many were set."""
    done = 0
    for r in sorted(rows, key=lambda r: -r["path"].count("/")):
        target = os.path.join(root, r["path"])
        try:
            if r.get("safe_mode"):
                os.chmod(target, r["safe_mode"])
            if r.get("mod_ns"):
                os.utime(target, ns=(r.get("access_ns") or r["mod_ns"], r["mod_ns"]))
            done += 1
        except OSError:
            continue
    return done
