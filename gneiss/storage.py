"""Written intermediate tables: lineage cuts in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests on one machine) a temporary folder is made, once per session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark.sparkContext, "_gneiss_dir", None) or tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext._gneiss_dir = found
    return found


#: Removes the shuffle files of a query when it ends; what a written table needed is not needed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back: it survives lost executors. Removed at exit."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gneiss/{uuid.uuid4().hex}"
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
    except Exception:  # the JVM may be gone before the interpreter: nothing is left to remove with
        pass
