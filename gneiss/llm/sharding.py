"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import global_rank, materialise, read_table, text_bytes

#: Rows that one task should rank at most, on average.
ROWS_PER_BUCKET = 100_000


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Put every row into one of ``shards`` shards whose mixture of sources equals that of the whole table.

    Within each source, rows are shuffled by the MD5 of the seed and the id and ranked; a row's fractional rank
    (2 rank + 1) / (2 rows of the source) spreads each source evenly over (0, 1). All rows are sorted by it and
    cut into equal runs, so counts differ by one at most (law ``rows``) and every shard holds each source in
    proportion. Ranks are global but taken inside buckets of the sort order, so a source with a third of all
    rows is spread over many tasks.

    Results: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source``. A null source is a stratum of
    its own; a null text counts as empty; a null id sorts first among equal hashes. Repeated rows take separate
    slots, which of two identical rows gets which slot makes no difference. More shards than rows leaves shards
    empty. Other columns are ignored.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    digits = max(2, min(7, len(f"{buckets * 16:x}")))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        text_bytes(F.col(text_col)).alias("_bytes"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("_order"),
    ).withColumn("_prefix", F.substring("_order", 1, digits))
    ranked = global_rank(base, ["source"], "_prefix", [F.col("_order"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("_bytes")], "_rank", "_rows")
    part = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_rows")).cast("double")
    cut = materialise(ranked.select("doc_id", "source", "text_crc32", (F.col("_bytes") + 1).alias("size"), part.alias("_part")).withColumn("_bucket", F.floor(F.col("_part") * buckets)))
    placed = global_rank(cut, [], "_bucket", [F.col("_part"), F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "_at", "_all")
    shard = F.expr(f"(_at * {shards}L) div _all")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - F.expr(f"(shard * _all + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


OP8_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
b AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(coalesce(text, ''))) + 1), lambda k: ('0x' || hex(encode(text)[k:k]))::BIGINT)),
        lambda a, x: xor(a >> 8, crc.t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32,
    md5('42|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents, crc),
r AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS part FROM b),
p AS (
  SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, ((pos * 8) // n)::INT AS shard, (pos - (((pos * 8) // n) * n + 7) // 8)::BIGINT AS slot,
  NULL::INT AS grown_shard, source
FROM p
"""
