"""Helpers shared by the training-data operators: table access, lineage cuts and salted global ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only separators that the contracts know, as a Java / RE2 / Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; the path goes to Spark's reader untouched, so any store works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors: ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is made and set once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark.sparkContext, "_gneiss_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="gneiss-checkpoints-")
            spark.sparkContext._gneiss_dir = found
    return found


#: Removes the shuffle files of a query when it ends; what a written table needed is not needed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: a lineage cut that survives lost executors.

    The shuffle files of the write go when it is done, so the disk need of a job of several phases is that of one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gneiss/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone before the interpreter: nothing is left to clean with
        pass


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after its session was told to hand at most ``rows`` rows at once to Python.

    Texts may be long: with the usual 10,000 rows, buffers on both sides take hundreds of megabytes. A session
    with a smaller setting keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of at most ``rows`` rows, so that Python objects of few rows live at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def global_rank(df: DataFrame, strata: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Add a 0-based ``rank`` within ``strata`` and the stratum's ``total``, without one task per stratum.

    ``bucket`` is a coarse prefix of the sort order: all rows of a lower bucket precede those of a higher one.
    Rows are counted per (strata, bucket), the counts are prefix-summed, and row numbers are taken inside
    (strata, bucket) only, so that a stratum with a third of all rows is spread over its buckets.
    """
    keys = [*strata, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn(total, F.sum("_n").over(whole)).drop("_n")
    left, right = df.alias("l"), counts.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = left.join(right, on, "inner").select("l.*", "r._before", f"r.{total}")
    within = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn(rank, F.col("_before") + F.row_number().over(within) - 1).drop("_before")
