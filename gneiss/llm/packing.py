"""Packing: optimal length buckets from the global histogram, token-budget batches inside each bucket."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import global_rank, materialise, read_table

#: Rows that one task should rank at most, on average.
ROWS_PER_BUCKET = 100_000


def count_tokens(text: Column) -> Column:
    """Words and single marks of a text, plus one end token: a length that needs no tokenizer."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]")), F.lit(0)) + 1).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that pad least, for a histogram of (length, rows).

    best(k, j) = min over i of best(k - 1, i) + padding of the lengths after i up to j. For a fixed j the cost
    is linear in the length at j, so each layer is one pass over a convex hull of lines: O(buckets x lengths).
    """
    merged: dict[int, int] = {}
    for length, n in histogram:
        merged[length] = merged.get(length, 0) + n
    lengths = sorted(merged)
    m = len(lengths)
    if not m:
        return []
    rows, tokens = [0], [0]
    for x in lengths:
        rows.append(rows[-1] + merged[x])
        tokens.append(tokens[-1] + merged[x] * x)
    best = [lengths[j - 1] * rows[j] - tokens[j] if j else 0 for j in range(m + 1)]
    choice: list[list[int]] = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, i; slopes fall
        new, frm = best[:], [0] * (m + 1)
        for j in range(1, m + 1):
            line = (-rows[j - 1], best[j - 1] + tokens[j - 1], j - 1)
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append(line)
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            slope, intercept, i = hull[0]
            new[j] = slope * x + intercept + x * rows[j] - tokens[j]
            frm[j] = i
        best = new
        choice.append(frm)
    bounds, j = [], m
    for frm in reversed(choice):
        if not j:
            break
        bounds.append(lengths[j - 1])
        j = frm[j]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 8, max_tokens: int = 2048, batch_tokens: int = 16_384, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """Assign every piece of every document to a length bucket and a batch of at most ``batch_tokens`` padded tokens.

    A document longer than ``max_tokens`` is cut into pieces of that many tokens and a rest. The exact histogram
    of piece lengths (at most ``max_tokens`` rows) goes to the driver, where dynamic programming chooses the
    bucket boundaries with the least padding. Inside a bucket, pieces are shuffled by a seeded hash and batched
    in that order; ranks are taken in slices of the hash range, so one bucket may hold most rows.

    ``length`` overrides the token count (values below 1 count as 1). Results: ``doc_id, piece, n_tokens,
    bucket, padded, batch, slot``. A null or empty text is one piece of one token; null ids and repeated rows
    are packed like others (which of two identical rows takes which slot makes no difference); other columns
    are ignored; an empty table gives an empty result.
    """
    size = F.greatest(F.coalesce(length if length is not None else count_tokens(F.col(text_col)), F.lit(1)).cast("long"), F.lit(1).cast("long"))
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), size.alias("_size")))
    pieces = sizes.select("doc_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_size - 1) div {max_tokens}"))).alias("piece")).select("doc_id", "piece", F.least(F.lit(max_tokens).cast("long"), F.col("_size") - F.col("piece") * max_tokens).alias("n_tokens"))
    histogram = [(r.n_tokens, r.n) for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = optimal_boundaries(histogram, buckets) or [1]
    groups = max(1, -(-sum(n for _, n in histogram) // ROWS_PER_BUCKET))
    digits = max(1, min(7, len(f"{groups * 16:x}")))
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(table, lambda b: b < F.col("n_tokens")))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("piece").cast("string")).cast("binary"))
    dealt = pieces.withColumn("bucket", bucket).withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, digits))
    ranked = global_rank(dealt, ["bucket"], "_slice", [F.col("_order"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens")], "_rank", "_total")
    padded = F.element_at(table, F.col("bucket") + 1)
    out = ranked.withColumn("padded", padded).withColumn("_each", F.greatest(F.lit(1).cast("long"), F.expr(f"{batch_tokens}L div padded")))
    return out.select("doc_id", "piece", "n_tokens", "bucket", "padded", F.expr("_rank div _each").alias("batch"), F.expr("_rank % _each").alias("slot"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))
