"""Checkpoints as Parquet tables below one folder; a manifest row, written last, says what is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 1
MANIFEST = "version int, complete boolean, image string, block_size int, partition_offset long, encrypted boolean, case_sensitive boolean"


def save_scan(folder: str, tables: dict[str, DataFrame], geometry: dict, complete: bool = True) -> None:
    """Replace the scan tables; the manifest goes first and comes back last, so a broken save is never loaded."""
    spark = next(iter(tables.values())).sparkSession
    row = {"version": VERSION, "complete": False, "image": None, "block_size": 4096, "partition_offset": 0, "encrypted": False, "case_sensitive": None} | geometry
    spark.createDataFrame([tuple({**row, "complete": False}[c.split(" ")[0]] for c in MANIFEST.split(", "))], MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([tuple({**row, "complete": complete}[c.split(" ")[0]] for c in MANIFEST.split(", "))], MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")


def load_scan(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict, dict[str, DataFrame]] | None:
    """(manifest, tables) of a complete scan of this version, else None."""
    try:
        row = spark.read.parquet(f"{folder}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if row is None or row.version != VERSION or not row.complete:
        return None
    return row.asDict(), {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def append_done(folder: str, done: DataFrame, run: int, more: bool = False) -> None:
    """Add the ids of a run to those that are finished; a repeated run replaces its own rows, ``more`` adds to them."""
    done.select("inode_id").distinct().write.mode("append" if more else "overwrite").parquet(f"{folder}/done/run={run}")


def load_done(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/done").select("inode_id").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "inode_id long")
        raise


def describe(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Row counts of the tables of a checkpoint, complete or not."""
    out = None
    for n in names:
        one = spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.union(one)
    return out
