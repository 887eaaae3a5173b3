"""Distributions of transaction ids: histogram, index percentiles, gaps and the advice drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, value: str, buckets: int = 20) -> DataFrame:
    """Equal-width buckets with their bounds and counts, empty buckets included."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest(F.expr(f"(hi - lo) div {buckets}"), F.lit(1).cast("long"))
    span = span.withColumn("width", width)
    found = df.crossJoin(F.broadcast(span)).select(F.least(F.expr(f"({value} - lo) div width"), F.lit(buckets - 1).cast("long")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(buckets).select(F.col("id").alias("bucket")).crossJoin(F.broadcast(span))
    return spine.join(found, "bucket", "left").select("bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Each value with its count, and how many rows come before it in the sorted order.

    Values are counted first, and the running sum is taken inside ranges of values and joined to the sums of
    the ranges before, so no task sees all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    parts = counts.crossJoin(F.broadcast(span)).withColumn("part", F.floor((F.col("value") - F.col("lo")).cast("double") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 999).cast("int")).drop("lo", "hi")
    sums = parts.groupBy("part").agg(F.sum("n").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a thousand rows at most
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_inside", inside).join(F.broadcast(before), "part").select("value", "n", (F.col("_inside") + F.col("_before")).alias("before"))


def index_percentiles(df: DataFrame, value: str, points: list[int]) -> DataFrame:
    """The element at index n*p/100 of the sorted values, without interpolation."""
    counts = value_counts(df, value)
    total = counts.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.createDataFrame([(p,) for p in points], "p int").crossJoin(F.broadcast(total)).select("p", F.least(F.expr("total * p div 100"), F.col("total") - 1).alias("at"))
    return counts.join(F.broadcast(wanted), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select("p", "value")


def gaps(df: DataFrame, value: str, keep: int = 1) -> DataFrame:
    """The largest distances between neighbouring values: ``gap, below, above``.

    Neighbours are found inside ranges of values; the ends of the ranges (a thousand rows at most) are joined up
    afterwards.
    """
    counts = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()
    span = counts.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    parts = counts.crossJoin(F.broadcast(span)).withColumn("part", F.floor((F.col("value") - F.col("lo")).cast("double") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 999).cast("int")).drop("lo", "hi")
    inner = parts.withColumn("below", F.lag("value").over(Window.partitionBy("part").orderBy("value"))).where("below IS NOT NULL").select((F.col("value") - F.col("below")).alias("gap"), "below", F.col("value").alias("above"))
    ends = parts.groupBy("part").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    outer = ends.withColumn("below", F.lag("last").over(Window.orderBy("part"))).where("below IS NOT NULL").select((F.col("first") - F.col("below")).alias("gap"), "below", F.col("first").alias("above"))
    return inner.union(outer).orderBy(F.desc("gap"), F.desc("below")).limit(keep)


def advise_cutoff(df: DataFrame, value: str) -> DataFrame:
    """One row: what the distribution looks like and which cut-off that suggests.

    ``tight`` (spread under 5 % of the largest value): the 75th percentile; ``two states`` (a gap of a fiftieth of
    the spread or more with a fifth of the values above it): the value above the gap; ``thin top`` (fewer
    above): the median; ``gradual``: the 75th percentile.
    """
    points = index_percentiles(df, value, [50, 75]).groupBy().agg(F.max(F.when(F.col("p") == 50, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 75, F.col("value"))).alias("p75"))
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    top = gaps(df, value)
    above = df.select(F.col(value).alias("_v")).join(F.broadcast(top), F.col("_v") >= F.col("above")).agg(F.count(F.lit(1)).alias("n_above"))
    one = span.crossJoin(points).join(top, F.lit(True), "left").crossJoin(above)
    spread = F.col("hi") - F.col("lo")
    share = 100.0 * F.col("n_above") / F.col("total")
    wide = F.col("gap") >= F.greatest(F.lit(1).cast("long"), F.expr("(hi - lo) div 50"))
    shape = F.when(spread < F.col("hi") * 0.05, "tight").when(wide & (share >= 20), "two states").when(wide, "thin top").otherwise("gradual")
    cut = F.when(F.col("shape") == "two states", F.col("above")).when(F.col("shape") == "thin top", F.col("p50")).otherwise(F.col("p75"))
    return one.withColumn("shape", shape).select("shape", cut.alias("cutoff"), "gap", "below", "above", "n_above", "p50", "p75")


def leading_zero_run(blocks: DataFrame, nonzero: str, number: str, total: int, least: int = 1000, most: int = 20_000) -> DataFrame:
    """How many blocks at the start are empty: 0 unless more than ``least``; a tenth of the image and ``most`` at most."""
    cap = min(most, total // 10)
    run = F.least(F.coalesce(F.min(F.when(F.col(nonzero), F.col(number))), F.lit(total).cast("long")), F.lit(cap).cast("long"))
    return blocks.agg(run.alias("run")).select(F.when(F.col("run") > least, F.col("run")).otherwise(F.lit(0).cast("long")).alias("zone"))
