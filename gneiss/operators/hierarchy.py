"""Paths from parent pointers: directories double their way up to the root; cycles and dangling chains never arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.storage import written

MAX_DEPTH = 100


def resolve_paths(entries: DataFrame, root: int = 2, max_depth: int = MAX_DEPTH, file: str = "file_inode", parent: str = "parent_inode", name: str = "name") -> DataFrame:
    """``inode_id, path, depth`` of every entry that hangs below ``root`` within ``max_depth`` parts.

    ``entries`` has one row per file. Directories double their way up: a row knows the names from an ancestor down to
    it, and in each round takes over the names of that ancestor, so a chain of n parts needs log2(n) joins. Members of
    cycles and of dangling chains never arrive at the root and have no path. Entries then join their directory once.
    Each round is a written table, so a lost executor repeats one round at most.
    """
    links = written(entries.select(F.col(file).alias("inode_id"), F.col(parent).alias("_above"), F.col(name).alias("path")).where(F.col(file) != root))
    parents = links.select(F.col("_above").alias("inode_id")).distinct()
    state = written(links.join(parents, "inode_id", "left_semi").withColumn("depth", F.lit(1)))
    for _ in range(max_depth.bit_length()):
        if state.where(F.col("_above") != root).isEmpty():
            break
        upper = state.select(F.col("inode_id").alias("_own"), F.col("_above").alias("_next"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        climbing = state.where(F.col("_above") != root).join(upper, F.col("_above") == F.col("_own"))
        climbed = climbing.select("inode_id", F.col("_next").alias("_above"), F.concat_ws("/", "_path", "path").alias("path"), (F.col("_depth") + F.col("depth")).alias("depth"))
        state = written(state.where(F.col("_above") == root).unionByName(climbed.where(F.col("depth") < max_depth)))
    folders = state.where(F.col("_above") == root).select(F.col("inode_id").alias("_own"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    top = links.where(F.col("_above") == root).select("inode_id", "path", F.lit(1).alias("depth"))
    below = links.join(folders, F.col("_above") == F.col("_own")).select("inode_id", F.concat_ws("/", "_path", "path").alias("path"), (F.col("_depth") + 1).alias("depth"))
    return top.unionByName(below.where(F.col("depth") <= max_depth))


def resolve_paths_sql(entries: DataFrame, root: int = 2, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The same as one recursive query, for hierarchies below Spark's recursion limits."""
    return entries.sparkSession.sql(
        f"""WITH RECURSIVE walk(inode_id, path, depth) AS (
              SELECT file_inode, name, 1 FROM {{e}} WHERE parent_inode = {root} AND file_inode <> {root}
              UNION ALL
              SELECT e.file_inode, concat(w.path, '/', e.name), w.depth + 1 FROM {{e}} e JOIN walk w ON e.parent_inode = w.inode_id
              WHERE w.depth < {max_depth} AND e.file_inode <> {root})
            SELECT inode_id, path, depth FROM walk""",
        e=entries,
    )
