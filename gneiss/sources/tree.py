"""Directory trees and folders of recovered blobs as DataFrames."""

from __future__ import annotations

import hashlib
import os
import stat

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_blobs(spark: SparkSession, folder: str, pattern: str = "*.dat", head_bytes: int | None = None) -> DataFrame:
    """``name, size, content`` of the files of a folder; content is all of it, or the first ``head_bytes``: a beginning is enough to look at, not to replace a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    content = F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), content.alias("content"))


def read_tree(spark: SparkSession, root: str, partitions: int = 8, digests: bool = True) -> DataFrame:
    """Everything below ``root``, by relative path: ``path, type, size, mode, mtime_ns, target, sha256``.

    The driver lists names only; what is read of each file is read by tasks, so ``root`` must be shared.
    """
    names = []
    for folder, dirs, files in os.walk(root):
        names += [os.path.relpath(os.path.join(folder, n), root) for n in [*dirs, *files]]
    listed = spark.createDataFrame([(n,) for n in sorted(names)], "path string").repartition(partitions)

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for n in batch.column(0).to_pylist():
                full = os.path.join(root, n)
                s = os.lstat(full)
                kind = "L" if stat.S_ISLNK(s.st_mode) else "D" if stat.S_ISDIR(s.st_mode) else "F"
                sha = None
                if kind == "F" and digests:
                    h = hashlib.sha256()
                    try:
                        with open(full, "rb") as f:
                            while chunk := f.read(1 << 20):
                                h.update(chunk)
                        sha = h.hexdigest()
                    except OSError as e:
                        sha = f"ERR:{e.errno}"
                rows.append((n, kind, s.st_size if kind == "F" else 0, s.st_mode & 0o7777, s.st_mtime_ns, os.readlink(full) if kind == "L" else None, sha))
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "type", "size", "mode", "mtime_ns", "target", "sha256"])

    return listed.mapInArrow(look, "path string, type string, size long, mode int, mtime_ns long, target string, sha256 string")


def manifest_lines(tree: DataFrame) -> DataFrame:
    """``sha256  path`` of readable files, in the form that checksum tools verify."""
    good = tree.where("type = 'F' AND sha256 IS NOT NULL AND NOT startswith(sha256, 'ERR:') AND sha256 <> '-'")
    return good.select(F.concat("sha256", F.lit("  "), "path").alias("value"))
