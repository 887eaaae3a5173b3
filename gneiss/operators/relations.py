"""Conflicting versions of one record: which directory entry, extent or field value counts.

Two forms are used. "Best row" operators keep one whole row per key by an aggregate of a struct, which combines
map-side, so a key with very many versions costs one row per task. Ties follow (block_num, ord), the order in
which a single reader meets the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """One row per key: the first by ``order`` (the last, if ``largest``), with all columns."""
    ranked = df.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    body = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = ranked.groupBy(*keys).agg((F.max_by if largest else F.min_by)(body, F.col("_order")).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_extents(extents: DataFrame, inode: str = "inode_id", logical: str = "logical", physical: str = "physical", order: tuple[str, ...] = ("block_num", "ord")) -> DataFrame:
    """Copy-on-write: of the extents of one file at one offset the one with the highest physical address counts."""
    return best_row(extents, [inode, logical], [-F.col(physical), *map(F.col, order)])


def known_directories(inodes: DataFrame, entries: DataFrame, root: int = 2) -> DataFrame:
    """Ids that an inode or a directory entry calls a directory, and the root."""
    spark = inodes.sparkSession
    first = spark.range(1).select(F.lit(root).cast("long").alias("inode_id"))
    return inodes.where("is_dir").select("inode_id").union(entries.where("is_dir").select(F.col("file_inode").alias("inode_id"))).union(first).distinct()


def one_entry_per_file(entries: DataFrame, directories: DataFrame, file: str = "file_inode", parent: str = "parent_inode", order: tuple[str, ...] = ("block_num", "ord"), directory: str = "inode_id") -> DataFrame:
    """Of several names of a file the first whose parent is a known directory, else the first; file 0 goes."""
    known = directories.select(F.col(directory).alias("_known")).distinct()
    flagged = entries.where(F.col(file) != 0).join(known, F.col(parent) == F.col("_known"), "left")
    flagged = flagged.withColumn("_strange", F.when(F.col("_known").isNull(), 1).otherwise(0)).drop("_known")
    return best_row(flagged, [file], [F.col("_strange"), *map(F.col, order)]).drop("_strange")


def link_counts(entries: DataFrame, file: str = "file_inode") -> DataFrame:
    """How many names each file has, most first; files with one name only are left out."""
    return entries.groupBy(file).agg(F.count(F.lit(1)).alias("n_links")).where("n_links > 1")


def merge_last(facts: DataFrame, key: str, order: list[str], fields: dict[str, Column | None]) -> DataFrame:
    """One row per key with, for each field, its value in the last fact that qualifies.

    ``fields`` maps a column to the condition under which a fact may set it (None: always, nulls included).
    """
    at = F.struct(*map(F.col, order))
    picks = []
    for name, when in fields.items():
        value = F.struct(F.col(name).alias("v"))
        chosen = F.max_by(value, at) if when is None else F.max_by(F.when(when, value), F.when(when, at))
        picks.append(chosen["v"].alias(name))
    return facts.groupBy(key).agg(*picks)


def plausible_extents(extents: DataFrame, total_blocks: int, block_size: int, partition_bytes: int) -> DataFrame:
    """Extents that lie inside the image: address, length and offset."""
    return extents.where((F.col("physical") < total_blocks) & (F.col("length") > 0) & (F.col("length") <= (F.lit(total_blocks).cast("long") - F.col("physical")) * block_size) & (F.col("logical") <= partition_bytes))


def clamp_sizes(size: Column, partition_bytes: int) -> Column:
    """A size larger than the partition is not known: 0."""
    return F.when(size > partition_bytes, F.lit(0).cast("long")).otherwise(size)


def trim_leading_zone(extents: DataFrame, zone: int, block_size: int, physical: str = "physical", length: str = "length", logical: str = "logical") -> DataFrame:
    """Cut from each extent the blocks below ``zone`` (a damaged area at the start); extents inside it go."""
    cut = F.greatest(F.lit(zone).cast("long") - F.col(physical), F.lit(0).cast("long"))
    left = F.col(length) - cut * block_size
    out = extents.withColumn("_cut", cut).withColumn("_left", left).where("_left > 0")
    return out.withColumn(physical, F.col(physical) + F.col("_cut")).withColumn(logical, F.col(logical) + F.col("_cut") * block_size).withColumn(length, F.col("_left")).drop("_cut", "_left")


def extent_blocks(extents: DataFrame, block_size: int, physical: str = "physical", length: str = "length") -> DataFrame:
    """One row per block of each extent: its place in the extent and its address (null where sparse)."""
    n = F.expr(f"({length} + {block_size - 1}) div {block_size}")
    out = extents.withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return out.withColumn("block_num", F.when(F.col(physical) != 0, F.col(physical) + F.col("block_index")))


def coverage(extents: DataFrame, inode: str = "inode_id", logical: str = "logical", length: str = "length") -> DataFrame:
    """Per file: how far its extents reach, how much they hold, and whether that is dense or at least not empty."""
    out = extents.groupBy(inode).agg(F.max(F.col(logical) + F.col(length)).alias("coverage"), F.sum(length).alias("held"))
    return out.withColumn("dense", F.col("held") >= F.expr("coverage div 2")).withColumn("nonempty", F.col("held") >= F.expr("coverage div 10"))


def possibly_truncated(files: DataFrame, block_size: int, size: str = "size") -> DataFrame:
    """Dense files whose extents reach over twice their size and ten blocks or more beyond it."""
    return files.where(F.col("dense") & (F.col(size) > 0) & (F.col("coverage") > 2 * F.col(size)) & (F.col("coverage") - F.col(size) >= 10 * block_size))


def resolve_keys(extents: DataFrame, defaults: DataFrame, states: DataFrame, volume_key: int = 0) -> DataFrame:
    """The key of each extent: its own id, else the file's default; ids without a state use the volume key."""
    chosen = extents.join(defaults.select(F.col("inode_id").alias("_inode"), "default_crypto_id"), F.col("inode_id") == F.col("_inode"), "left").drop("_inode")
    chosen = chosen.withColumn("wanted_key", F.when(F.col("crypto_id") != 0, F.col("crypto_id")).otherwise(F.coalesce("default_crypto_id", F.lit(0).cast("long"))))
    known = states.select(F.col("crypto_id").alias("_state")).distinct()
    return chosen.join(known, F.col("wanted_key") == F.col("_state"), "left").withColumn("used_key", F.coalesce("_state", F.lit(volume_key).cast("long"))).drop("_state", "default_crypto_id")
