"""Duplicates by content: a file's signature is its size and the digest of its beginning, or of all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SIGNATURE_BYTES = 65_536


def signature(content: Column) -> list[Column]:
    return [F.octet_length(content).alias("size"), F.sha2(F.substring(content, 1, SIGNATURE_BYTES), 256).alias("digest")]


def full_signature(content: Column) -> list[Column]:
    return [F.octet_length(content).alias("size"), F.sha2(content, 256).alias("digest")]


def first_of_each(files: DataFrame, order: list[str]) -> DataFrame:
    """Of files with one signature (``size, digest``) the first by ``order``."""
    from .relations import best_row

    return best_row(files, ["size", "digest"], [F.col(c) for c in order])


def duplicate_groups(files: DataFrame, name: str) -> DataFrame:
    """Groups of two or more equal files, the name that is kept, and how many are redundant.

    Sizes that occur once are removed first, by an aggregate without digests; only the others are compared.
    """
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    rest = files.join(sizes, "size", "left_semi")
    return rest.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("kept")).where("copies > 1").withColumn("redundant", F.col("copies") - 1)
