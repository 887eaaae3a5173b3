"""What is to be recovered: named files and orphans, without directories, finished and filtered ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.scalars import last_extension

DEFAULT_MAX_SIZE = 50 * 1024**3


def orphans(inodes: DataFrame, extents: DataFrame, directories: DataFrame, named: DataFrame) -> DataFrame:
    """Inodes with extents that are no directory and have no name."""
    holding = extents.select("inode_id").distinct()
    return inodes.join(holding, "inode_id", "left_semi").join(directories, "inode_id", "left_anti").join(named, "inode_id", "left_anti")


def without_done(work: DataFrame, done: DataFrame, key: str = "inode_id") -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def work_list(named: DataFrame, lost: DataFrame, extents: DataFrame) -> DataFrame:
    """Named files and orphans, each file once (a name wins), with their first physical block, in its order.

    Files without extents come last. The order is by range partitions, so that each task reads one stretch of
    the image forward.
    """
    both = named.select("inode_id", F.lit(False).alias("is_orphan")).union(lost.select("inode_id", F.lit(True).alias("is_orphan")))
    once = both.groupBy("inode_id").agg(F.min("is_orphan").alias("is_orphan"))
    first = extents.groupBy("inode_id").agg(F.min_by("physical", F.struct("logical", "physical")).alias("first_phys"))
    listed = once.join(first, "inode_id", "left")
    key = [F.col("first_phys").asc_nulls_last(), F.col("inode_id").asc()]
    return listed.repartitionByRange(*key).sortWithinPartitions(*key)


def wanted_extensions(name: Column, extensions: list[str]) -> Column:
    return last_extension(name).isin(*[e.lower().lstrip(".") for e in extensions])


def pilot(path: Column, part: str) -> Column:
    """Paths that contain ``part``; a file without a path passes."""
    return path.isNull() | F.contains(path, F.lit(part))


def size_reason(size: Column, least: int = 0, most: int = DEFAULT_MAX_SIZE) -> Column:
    """Null if the size is wanted, else why not."""
    return F.when(size < least, "below minimum size").when(size > most, "above maximum size")


def is_garbage_name(path: Column) -> Column:
    """Names that stand for no place in the tree: such files are treated as orphans."""
    return path.isNull() | (path == "") | (F.element_at(F.split(path, "/"), -1) == ":")


def collision_names(files: DataFrame, path: str = "path", order: tuple[str, ...] = ("first_phys", "inode_id")) -> DataFrame:
    """Files that want one path get ``_COLLISION``, ``_COLLISION_2``, ... before their extension, in order.

    Only the paths that are wanted twice go through the window; all others pass by.
    """
    from pyspark.sql.window import Window

    from gneiss.functions.scalars import suffix_before_extension

    crowded = files.groupBy(path).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    alone = files.join(crowded, path, "left_anti").withColumn("actual_path", F.col(path))
    rank = F.row_number().over(Window.partitionBy(path).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    shared = files.join(crowded, path, "left_semi").withColumn("_rank", rank)
    suffix = F.when(F.col("_rank") == 2, F.lit("_COLLISION")).otherwise(F.concat(F.lit("_COLLISION_"), (F.col("_rank") - 1).cast("string")))
    shared = shared.withColumn("actual_path", F.when(F.col("_rank") == 1, F.col(path)).otherwise(suffix_before_extension(F.col(path), suffix))).drop("_rank")
    return alone.unionByName(shared)
