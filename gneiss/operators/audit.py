"""Counts, rates and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def consolidate(runs: DataFrame, first_only: list[str], summed: list[str], run: str = "run") -> DataFrame:
    """Totals over runs: sums of counters; what a first run found is taken from it alone."""
    return runs.agg(*[F.min_by(c, run).alias(c) for c in first_only], *[F.sum(c).alias(c) for c in summed])


def recovery_percent(done: Column, found: Column) -> Column:
    return F.when(found > 0, F.least(F.lit(100.0), 100.0 * done / found)).otherwise(0.0)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Added, removed and changed keys between two snapshots."""
    a = before.select(F.col(key).alias("_a"), F.col(digest).alias("_da"))
    b = after.select(F.col(key).alias("_b"), F.col(digest).alias("_db"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_da").eqNullSafe(F.col("_db")), "changed")
    return both.select(F.coalesce("_a", "_b").alias(key), what.alias("change")).where("change IS NOT NULL")


def verify_manifest(manifest: DataFrame, files: DataFrame, key: str, digest: str) -> DataFrame:
    """For every entry of the manifest: OK, FAILED or MISSING."""
    have = files.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return manifest.join(have, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_k").isNull(), "MISSING").when(F.col(digest) == F.col("_d"), "OK").otherwise("FAILED").alias("result"))


def by_category(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def tree_totals(files: DataFrame, size: str = "size") -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
