"""Classification of blobs as they arrive in a folder; finished files are remembered by the query's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.functions.classify import classify_deep, is_noise

FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str, pattern: str = "*.dat", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def classified(files: DataFrame, head_bytes: int = 262_144) -> DataFrame:
    """``name, size, outcome, extension`` of each file; a narrow map, so there is no state to keep."""
    head = F.substring("content", 1, head_bytes)
    ext = classify_deep(head)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.when(is_noise(F.col("content")), "noise").when(ext.isNotNull(), "identified").otherwise("unknown").alias("outcome"), ext.alias("extension"), F.col("modificationTime").alias("arrived"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append results to Parquet until all files that are there now are done; a restart continues after them."""
    return classified(incoming(spark, folder, **options)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def outcomes_by_hour(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running counts by arrival hour and outcome; rows later than ``late`` are left to the batch report."""
    return results.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour"), "outcome").agg(F.count(F.lit(1)).alias("n"))
