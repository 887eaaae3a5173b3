"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, materialise, read_table, shuffle_partitions

KEY = ["_slice", "_digest", "_bytes", "_check"]
#: Slices of the digest space for each shuffle partition, so that every level has many small runs to deal out.
SLICES_PER_PARTITION = 16


def digests(docs: DataFrame, runs: int, slices: int, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: its run, the SHA-256 of its normalised text, its slice and a check value."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.select("doc_id", F.sha2("_text", 256).alias("_hex"), F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check"))
    return rows.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("_run"),
        F.pmod(F.conv(F.substring("_hex", 1, 8), 16, 10).cast("long"), F.lit(slices)).cast("int").alias("_slice"),
        F.unhex("_hex").alias("_digest"),
        "_bytes",
        "_check",
    )


def merged(runs: DataFrame) -> DataFrame:
    """Runs that lie in one place become one: sorted by key, equal neighbours are one entry.

    The entry keeps the smallest identifier and the sum of the rows. The order by key and the pass over neighbours
    are a sort and a sort-based aggregate: its state, a struct, is none that a hash aggregate could hold.
    """
    placed = runs.repartition("_slice", "_run").sortWithinPartitions("_run", *KEY)
    best = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id")).alias("_best")
    return placed.groupBy("_run", *KEY).agg(best, F.sum("group_size").alias("group_size")).select("_run", *KEY, F.col("_best.keep_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256) -> DataFrame:
    """Mark, for every row, the row of equal normalised text that stays.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as empty.
    Rows are dealt to ``runs`` (rounded up to a power of two) by their id and to slices by their digest. Each (slice,
    run) is a sorted run with one entry for equal digests that agree in byte length and a second hash. In round r of
    log2(runs) binomial rounds, the runs with bit r set go to the run without it and both are merged, with the smallest
    identifier kept at every level. A slice's last run is a bounded part of the digest space. Digests of several rows
    then return to the first runs, of which each has one entry for it, and from there to the rows, so a group with a
    third of all rows is spread over all runs on both ways.

    Results: ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row. Repeated rows with
    one id are one document (all of them stay or go together) but count in ``group_size``. A null id sorts
    after all others; a group of null ids only keeps them (``keep_id`` null). Other columns, whatever their names, are
    ignored. Texts of any length are read whole. An empty table gives an empty result.
    """
    rounds = max(0, runs - 1).bit_length()
    slices = SLICES_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    leaves = materialise(digests(docs, 1 << rounds, slices, id_col, text_col))
    first = materialise(merged(leaves.groupBy("_run", *KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))))
    level = first
    for r in range(rounds):
        level = merged(level.withColumn("_run", F.col("_run").bitwiseAND(F.lit(~(1 << r)))))
    several = level.where("group_size > 1").select(*KEY, "keep_id", "group_size")
    answer = first.select("_run", *KEY).join(several, KEY)
    found = leaves.join(answer, ["_run", *KEY], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the one of its equals that stays; odd rows as in ``exact_dedup``."""
    return exact_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
