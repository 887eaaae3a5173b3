"""Queries over Parquet tables, one per operator, each with the same meaning in SQL for DuckDB.

The tables hold no disk image, so each query applies an operator to columns that play the same part: line items
are extents (order = file, line number = offset, part = physical address), events are directory entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from gneiss.functions import classify as C, scalars as X
from gneiss.operators import audit, dedup, hierarchy, relations as R, stats, worklist as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extents(spark: SparkSession, d: str) -> DataFrame:
    """Line items as extents."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("inode_id"), (F.col("l_linenumber").cast("long") * 4096).alias("logical"), F.col("l_partkey").alias("physical"),
        (F.col("l_quantity") * 512).cast("long").alias("length"), F.col("l_suppkey").alias("block_num"), F.col("l_linenumber").alias("ord"))


EXT = "SELECT l_orderkey AS inode_id, l_linenumber::BIGINT * 4096 AS logical, l_partkey AS physical, (l_quantity * 512)::BIGINT AS length, l_suppkey AS block_num, l_linenumber AS ord FROM lineitem"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Latest extents of each file, then how far they reach and how much they hold."""
    latest = R.latest_extents(extents(spark, d), order=("block_num", "ord", "length"))
    return R.coverage(latest)


# ---- relations -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS inode_id, l_linenumber AS logical, max(l_partkey) AS physical FROM lineitem GROUP BY ALL")
def extent_cow_latest(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").alias("logical"), F.col("l_partkey").alias("physical"), F.col("l_suppkey").alias("block_num"), F.col("l_quantity").alias("ord"))
    return R.latest_extents(li).select("inode_id", "logical", "physical")


@query(f"""WITH e AS ({EXT}), l AS (SELECT *, row_number() OVER (PARTITION BY inode_id, logical ORDER BY physical DESC, block_num, ord, length) AS r FROM e)
SELECT inode_id, max(logical + length)::BIGINT AS coverage, sum(length)::BIGINT AS held, sum(length) >= max(logical + length) // 2 AS dense, sum(length) >= max(logical + length) // 10 AS nonempty
FROM l WHERE r = 1 GROUP BY inode_id""")
def extent_coverage_density(spark, d):
    return flagship(spark, d)


@query("""WITH c AS (SELECT l_orderkey AS inode_id, max(l_linenumber::BIGINT * 65536 + (l_quantity * 512)::BIGINT) AS coverage, sum((l_quantity * 8192)::BIGINT)::BIGINT AS held FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS size FROM orders)
SELECT inode_id, size, coverage FROM c JOIN s ON inode_id = o_orderkey WHERE held >= coverage // 2 AND size > 0 AND coverage > 2 * size AND coverage - size >= 40960""")
def possibly_truncated(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), (F.col("l_linenumber").cast("long") * 65536).alias("logical"), (F.col("l_quantity") * 512).cast("long").alias("near"), (F.col("l_quantity") * 8192).cast("long").alias("length"))
    cov = e.groupBy("inode_id").agg(F.max(F.col("logical") + F.col("near")).alias("coverage"), F.sum("length").alias("held")).withColumn("dense", F.col("held") >= F.expr("coverage div 2"))
    sizes = table(spark, d, "orders").select(F.col("o_orderkey").alias("inode_id"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("size"))
    return R.possibly_truncated(cov.join(sizes, "inode_id"), 4096).select("inode_id", "size", "coverage")


@query("""SELECT file_inode, parent_inode, event_id AS block_num FROM (
  SELECT user_id AS file_inode, event_id % 997 AS parent_inode, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END, event_id) AS r
  FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) ON event_id % 997 = c_custkey WHERE user_id <> 0) WHERE r = 1""")
def drec_dedupe_known_parent(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file_inode"), (F.col("event_id") % 997).alias("parent_inode"), F.col("event_id").alias("block_num"), F.lit(0).alias("ord"))
    known = table(spark, d, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("inode_id"))
    return R.one_entry_per_file(e, known).select("file_inode", "parent_inode", "block_num")


@query("SELECT l_partkey AS file_inode, count(*) AS n_links FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def hardlink_multiplicity(spark, d):
    return R.link_counts(table(spark, d, "lineitem"), "l_partkey").withColumnRenamed("l_partkey", "file_inode")


@query("""SELECT user_id AS inode_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase, arg_max(event_id, (ts, event_id)) FILTER (WHERE value > 50) AS last_large
FROM events GROUP BY user_id""")
def inode_last_writer(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("inode_id"), "ts", "event_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_purchase"), F.col("event_id").alias("last_large"))
    return R.merge_last(e, "inode_id", ["ts", "event_id"], {"last_type": None, "last_purchase": F.col("last_type") == "purchase", "last_large": F.col("last_purchase") > 50})


@query("""SELECT l_orderkey AS inode_id, l_linenumber AS logical, CASE WHEN s_suppkey IS NULL THEN 0 ELSE wanted END AS used_key, l_partkey AS physical FROM (
  SELECT *, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey ELSE o_custkey % 50 END AS wanted FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) ON wanted = s_suppkey""")
def crypto_fallback(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").alias("logical"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).otherwise(0).alias("crypto_id"), F.col("l_partkey").alias("physical"))
    defaults = table(spark, d, "orders").select(F.col("o_orderkey").alias("inode_id"), (F.col("o_custkey") % 50).alias("default_crypto_id"))
    states = table(spark, d, "supplier").where("s_acctbal > 4000").select(F.col("s_suppkey").alias("crypto_id"))
    return R.resolve_keys(e, defaults, states).select("inode_id", "logical", "used_key", "physical")


@query("""SELECT inode_id, logical, b AS block_index, CASE WHEN physical <> 0 THEN physical + b END AS block_num FROM (
  SELECT l_orderkey AS inode_id, l_linenumber AS logical, l_partkey % 100 AS physical, unnest(range(0, ((l_quantity * 512)::BIGINT + 4095) // 4096)) AS b FROM lineitem)""")
def extent_block_explode(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").alias("logical"), (F.col("l_partkey") % 100).alias("physical"), (F.col("l_quantity") * 512).cast("long").alias("length"))
    return R.extent_blocks(e, 4096).select("inode_id", "logical", "block_index", "block_num")


@query(f"""WITH e AS ({EXT}) SELECT inode_id, logical + greatest(300 - physical, 0) * 512 AS logical, physical + greatest(300 - physical, 0) AS physical, length - greatest(300 - physical, 0) * 512 AS length, block_num
FROM e WHERE length - greatest(300 - physical, 0) * 512 > 0""")
def head_crash_trim(spark, d):
    return R.trim_leading_zone(extents(spark, d), 300, 512).select("inode_id", "logical", "physical", "length", "block_num")


@query(f"WITH e AS ({EXT}) SELECT inode_id, logical, physical, length, block_num FROM e WHERE physical < 1500 AND length > 0 AND length <= (1500 - physical) * 16 AND logical <= 20000")
def extent_bounds(spark, d):
    return R.plausible_extents(extents(spark, d), 1500, 16, 20_000).select("inode_id", "logical", "physical", "length", "block_num")


@query("SELECT o_orderkey AS inode_id, CASE WHEN floor(o_totalprice)::BIGINT > 200000 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS size FROM orders")
def size_clamp(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("inode_id"), R.clamp_sizes(F.floor("o_totalprice").cast("long"), 200_000).alias("size"))


# ---- statistics ----------------------------------------------------------------------------------------------------

XIDS = "SELECT (epoch_us(o_orderdate) // 1000000)::BIGINT AS xid FROM orders"


def xids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("xid"))


@query(f"WITH x AS ({XIDS}), r AS (SELECT xid, row_number() OVER (ORDER BY xid) - 1 AS i, count(*) OVER () AS n FROM x) SELECT p, xid AS value FROM r JOIN (SELECT unnest([0, 10, 25, 50, 75, 90, 99, 100]) AS p) ON i = least(n * p // 100, n - 1)")
def xid_percentiles(spark, d):
    return stats.index_percentiles(xids(spark, d), "xid", [0, 10, 25, 50, 75, 90, 99, 100])


@query(f"""WITH x AS ({XIDS}), s AS (SELECT min(xid) AS lo, greatest((max(xid) - min(xid)) // 20, 1) AS w FROM x), h AS (SELECT least((xid - lo) // w, 19) AS bucket, count(*) AS n FROM x, s GROUP BY 1)
SELECT b AS bucket, lo + b * w AS low, coalesce(n, 0) AS n FROM range(20) t(b), s LEFT JOIN h ON h.bucket = b""")
def xid_histogram(spark, d):
    return stats.histogram(xids(spark, d), "xid")


@query(f"WITH x AS (SELECT DISTINCT xid FROM ({XIDS})), g AS (SELECT xid - lag(xid) OVER (ORDER BY xid) AS gap, lag(xid) OVER (ORDER BY xid) AS below, xid AS above FROM x) SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, below DESC LIMIT 5")
def xid_gap(spark, d):
    return stats.gaps(xids(spark, d), "xid", 5)


@query(f"""WITH x AS ({XIDS}), r AS (SELECT xid, row_number() OVER (ORDER BY xid) - 1 AS i, count(*) OVER () AS n FROM x),
q AS (SELECT max(xid) FILTER (WHERE i = least(n * 50 // 100, n - 1)) AS p50, max(xid) FILTER (WHERE i = least(n * 75 // 100, n - 1)) AS p75, min(xid) AS lo, max(xid) AS hi, count(*) AS total FROM r),
d AS (SELECT DISTINCT xid FROM x), g AS (SELECT xid - lag(xid) OVER (ORDER BY xid) AS gap, lag(xid) OVER (ORDER BY xid) AS below, xid AS above FROM d), t AS (SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, below DESC LIMIT 1),
a AS (SELECT count(*) AS n_above FROM x, t WHERE xid >= above),
s AS (SELECT *, CASE WHEN hi - lo < hi * 0.05 THEN 'tight' WHEN gap >= greatest(1, (hi - lo) // 50) THEN CASE WHEN 100.0 * n_above / total >= 20 THEN 'two states' ELSE 'thin top' END ELSE 'gradual' END AS shape FROM q, t, a)
SELECT shape, CASE shape WHEN 'two states' THEN above WHEN 'thin top' THEN p50 ELSE p75 END AS cutoff, gap, below, above, n_above, p50, p75 FROM s""")
def xid_advice(spark, d):
    return stats.advise_cutoff(xids(spark, d), "xid")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 5000")
def min_xid_filter(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") >= 5000).select("o_orderkey", "o_custkey")


@query("SELECT CASE WHEN run > 100 THEN run ELSE 0 END AS zone FROM (SELECT least(coalesce(min(event_id) FILTER (WHERE value > 499.5), count(*)), least(20000, count(*) // 10)) AS run FROM events)")
def leading_zero_run(spark, d):
    e = table(spark, d, "events")
    return stats.leading_zero_run(e.withColumn("nonzero", F.col("value") > 499.5), "nonzero", "event_id", e.count(), least=100)


@query("SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY 1")
def superblock_argmax(spark, d):
    return R.best_row(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [-F.col("p_size"), F.col("p_partkey")])


@query("SELECT least(l_orderkey // 1000, 7) AS worker, count(*) AS nodes, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1")
def scan_partition_ranges(spark, d):
    return table(spark, d, "lineitem").groupBy(F.least(F.expr("l_orderkey div 1000"), F.lit(7).cast("long")).alias("worker")).agg(F.count(F.lit(1)).alias("nodes"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


# ---- hierarchy and work lists --------------------------------------------------------------------------------------


def parts_tree(spark: SparkSession, d: str) -> DataFrame:
    """Part keys as a forest: the parent of k is k div 10; single digits hang below the root, some below themselves."""
    k = F.col("p_partkey")
    parent = F.when(k % 97 == 0, k).when(k < 10, F.lit(0)).otherwise(F.expr("p_partkey div 10"))
    return table(spark, d, "part").select(k.alias("file_inode"), parent.alias("parent_inode"), F.concat(F.lit("n"), k.cast("string")).alias("name")).where("file_inode <> 0")


TREE = "SELECT p_partkey AS f, CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey < 10 THEN 0 ELSE p_partkey // 10 END AS p, 'n' || p_partkey AS name FROM part WHERE p_partkey <> 0"
WALK = f"WITH RECURSIVE e AS ({TREE}), w AS (SELECT f, name AS path, 1 AS depth FROM e WHERE p = 0 UNION ALL SELECT e.f, w.path || '/' || e.name, w.depth + 1 FROM e JOIN w ON e.p = w.f WHERE w.depth < 100)"


@query(f"{WALK} SELECT f AS inode_id, path, depth FROM w")
def path_resolve(spark, d):
    return hierarchy.resolve_paths(parts_tree(spark, d), root=0)


@query(f"{WALK} SELECT e.f AS inode_id FROM e WHERE e.f NOT IN (SELECT f FROM w)")
def path_unresolved(spark, d):
    tree = parts_tree(spark, d)
    return tree.select(F.col("file_inode").alias("inode_id")).join(hierarchy.resolve_paths(tree, root=0), "inode_id", "left_anti")


@query(f"{WALK} SELECT depth, count(*) AS n FROM w GROUP BY depth")
def path_cycle_guard(spark, d):
    return hierarchy.resolve_paths(parts_tree(spark, d), root=0).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_regionkey * 0 + c_custkey AS inode_id, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def path_by_names(spark, d):
    base = 10**9
    region = table(spark, d, "region").select((F.col("r_regionkey") + F.lit(base)).cast("long").alias("file_inode"), F.lit(-1).cast("long").alias("parent_inode"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + F.lit(base + 1000)).cast("long").alias("file_inode"), (F.col("n_regionkey") + F.lit(base)).cast("long").alias("parent_inode"), F.col("n_name").alias("name"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("file_inode"), (F.col("c_nationkey") + F.lit(base + 1000)).cast("long").alias("parent_inode"), F.col("c_name").alias("name"))
    return hierarchy.resolve_paths(region.union(nation).union(customer), root=-1).where("depth = 3").select("inode_id", "path")


@query("SELECT doc_id AS inode_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr' AND n_chars > 100")
def orphan_anti_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("inode_id"), "n_chars", "lang")
    holding = docs.where("n_chars > 100")
    named = table(spark, d, "labels").select(F.col("doc_id").alias("inode_id"))
    return W.orphans(docs.select("inode_id"), holding, docs.where("lang = 'fr'").select("inode_id"), named)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def done_set_anti(spark, d):
    return W.without_done(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS known FROM orders")
def dir_semi(spark, d):
    dirs = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("_k")).distinct()
    return table(spark, d, "orders").join(dirs, F.col("o_custkey") == F.col("_k"), "left").select("o_orderkey", "o_custkey", F.col("_k").isNotNull().alias("known"))


@query("SELECT DISTINCT inode_id FROM (SELECT o_custkey AS inode_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT 2)")
def dir_id_union(spark, d):
    inodes = table(spark, d, "customer").select(F.col("c_custkey").alias("inode_id"), (F.col("c_acctbal") < 0).alias("is_dir"))
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("file_inode"), (F.col("o_orderstatus") == "F").alias("is_dir"))
    return R.known_directories(inodes, entries)


@query("""WITH b AS (SELECT doc_id AS inode_id, false AS is_orphan FROM labels UNION ALL SELECT doc_id, true FROM documents), o AS (SELECT inode_id, min(is_orphan) AS is_orphan FROM b GROUP BY 1),
f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_phys FROM lineitem GROUP BY 1)
SELECT inode_id, is_orphan, first_phys FROM o LEFT JOIN f ON l_orderkey = inode_id""")
def worklist_union_sorted(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").alias("logical"), F.col("l_partkey").alias("physical"))
    ids = lambda t: table(spark, d, t).select(F.col("doc_id").alias("inode_id"))
    return W.work_list(ids("labels"), ids("documents"), e).select("inode_id", "is_orphan", "first_phys")


@query(r"SELECT page_id, url, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '\.([^./]+)$', 1)) IN ('html', 'php')")
def filter_ext(spark, d):
    return table(spark, d, "pages").where(W.wanted_extensions(F.col("url"), ["HTML", ".php"])).select("page_id", "url", X.last_extension(F.col("url")).alias("ext"))


@query("SELECT page_id, url FROM pages WHERE url IS NULL OR contains(url, '/en/')")
def pilot(spark, d):
    return table(spark, d, "pages").where(W.pilot(F.col("url"), "/en/")).select("page_id", "url")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND n_chars <= 5000")
def size_window(spark, d):
    return table(spark, d, "documents").where(W.size_reason(F.col("n_chars"), 200, 5000).isNull()).select("doc_id", "n_chars")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'below minimum size' WHEN n_chars > 5000 THEN 'above maximum size' ELSE 'wanted' END AS reason FROM documents) GROUP BY 1")
def skip_reasons(spark, d):
    return audit.by_category(table(spark, d, "documents").select(F.coalesce(W.size_reason(F.col("n_chars"), 200, 5000), F.lit("wanted")).alias("reason")), "reason")


@query(r"""WITH p AS (SELECT page_id, coalesce(CASE WHEN page_id % 11 = 0 THEN ':' WHEN page_id % 13 = 0 THEN '' END, url) AS path FROM pages) SELECT page_id, path IS NULL OR path = '' OR list_last(string_split(path, '/')) = ':' AS garbage FROM p""")
def garbage_names(spark, d):
    p = F.col("page_id")
    return table(spark, d, "pages").select(p, F.when(p % 11 == 0, ":").when(p % 13 == 0, "").otherwise(F.col("url")).alias("path")).select("page_id", W.is_garbage_name(F.col("path")).alias("garbage"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || '/index.html' AS path FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS r FROM p)
SELECT page_id, path, CASE WHEN r = 1 THEN path ELSE regexp_extract(path, '^(.*[^/])(\.[^./]*)$', 1) || CASE WHEN r = 2 THEN '_COLLISION' ELSE '_COLLISION_' || (r - 1) END || regexp_extract(path, '^(.*[^/])(\.[^./]*)$', 2) END AS actual_path FROM r""")
def collision_suffix(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("/index.html")).alias("path"))
    return W.collision_names(p, order=("page_id",)).select("page_id", "path", "actual_path")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(.*[^/])(\.[^./]*)$') THEN regexp_extract(url, '^(.*[^/])(\.[^./]*)$', 1) || '_EXPANDED' || regexp_extract(url, '^(.*[^/])(\.[^./]*)$', 2) ELSE url || '_EXPANDED' END AS path FROM pages""")
def expanded_suffix(spark, d):
    return table(spark, d, "pages").select("page_id", X.suffix_before_extension(F.col("url"), "_EXPANDED").alias("path"))


# ---- duplicates ----------------------------------------------------------------------------------------------------


def signed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *dedup.signature(F.col("text").cast("binary")))


def whole(spark: SparkSession, d: str) -> DataFrame:
    """Digests of whole texts."""
    return table(spark, d, "documents").select("doc_id", *dedup.full_signature(F.col("text").cast("binary")))


SIGNED = "SELECT doc_id, octet_length(encode(text)) AS size, sha256(encode(text)[1:65536]) AS digest FROM documents"
WHOLE = "SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents"


@query(f"SELECT min(doc_id) AS doc_id, size::INT AS size, digest FROM ({SIGNED}) GROUP BY size, digest")
def content_dedup(spark, d):
    return dedup.first_of_each(signed(spark, d), ["doc_id"])


@query(f"SELECT size::INT AS size, digest, count(*) AS copies, min(doc_id) AS kept, count(*) - 1 AS redundant FROM ({WHOLE}) GROUP BY size, digest HAVING count(*) > 1")
def dup_groups(spark, d):
    return dedup.duplicate_groups(whole(spark, d), "doc_id")


@query(f"SELECT sum(n - 1)::BIGINT AS redundant, count(*) AS n_groups FROM (SELECT count(*) AS n FROM ({WHOLE}) GROUP BY size, digest HAVING count(*) > 1)")
def dup_redundant(spark, d):
    return dedup.duplicate_groups(whole(spark, d), "doc_id").agg(F.sum("redundant").alias("redundant"), F.count(F.lit(1)).alias("n_groups"))


# ---- content -------------------------------------------------------------------------------------------------------

LATIN = "(SELECT coalesce(string_agg(chr(('0x' || b)::INT), '' ORDER BY i), '') FROM (SELECT unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT regexp_extract_all(hex(encode({t})[1:{n}]), '..') AS bs)))"


def classify_sql(t: str) -> str:
    """The classification of a UTF-8 text column in SQL, without the UTF-16 guess, which UTF-8 text cannot meet."""
    head = f"hex(encode({t})[1:16])"
    rules = []
    refine = {"riff": "CASE " + " ".join(f"WHEN substr(h, 17, 8) = '{raw.hex().upper()}' THEN '{e}'" for raw, e in C.RIFF) + " ELSE 'riff' END", "ftyp": "CASE " + " ".join(f"WHEN substr(h, 17, 8) = '{raw.hex().upper()}' THEN '{e}'" for raw, e in C.FTYP) + " ELSE 'mp4' END"}
    for offset, raw, ext in C.MAGIC:
        if ext != "utf16":
            rules.append(f"WHEN substr(h, {2 * offset + 1}, {2 * len(raw)}) = '{raw.hex().upper()}' THEN " + refine.get(ext, f"'{ext}'"))
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, ext in C.TEXT:
        rules.append(f"WHEN contains(lower(v), {quoted(pattern)}) THEN '{ext}'")
    rules.append(r"WHEN length(regexp_replace(s, '[^\x09-\x0d\x20-\x7e]', '', 'g')) * 100 // length(s) >= 85 THEN 'txt'")
    bad = r"length(regexp_replace(s, '[\x09-\x0d\x20-\x7e]|[\x{c2}-\x{df}][\x{80}-\x{bf}]|[\x{e0}-\x{ef}][\x{80}-\x{bf}]{2}|[\x{f0}-\x{f4}][\x{80}-\x{bf}]{3}', '', 'g'))"
    rules.append(f"WHEN (length(s) - {bad}) * 100 // length(s) >= 60 AND {bad} * 100 // length(s) < 10 THEN 'txt'")
    return f"{head} AS h, {LATIN.format(t=t, n=C.PREVIEW)} AS v, {LATIN.format(t=t, n=C.SAMPLE)} AS s", "CASE WHEN h = '' THEN NULL " + " ".join(rules) + " END"


def _classify_query(name: str, key: str, text: str):
    views, case = classify_sql(text)

    def run(spark, d, name=name, key=key, text=text):
        return table(spark, d, name).select(*[k.strip() for k in key.split(",")], C.classify(F.col(text).cast("binary")).alias("ext"))

    run.__name__ = f"classify_{name}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"SELECT {key}, {case} AS ext FROM (SELECT {key}, {views} FROM {name})"


for _name, _key, _text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id, turn", "text")):
    _classify_query(_name, _key, _text)


@query("SELECT ext, count(*) AS n FROM (" + SQL["classify_conversations"] + ") GROUP BY ext ORDER BY n DESC, ext LIMIT 30")
def top_extensions(spark, d):
    return QUERIES["classify_conversations"](spark, d).groupBy("ext").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(30)


@query("SELECT doc_id, length(regexp_replace(s, '[^\\x09-\\x0d\\x20-\\x7e]', '', 'g')) * 100 // length(s) AS percent FROM (SELECT doc_id, " + LATIN.format(t="text", n=256) + " AS s FROM documents)")
def printable_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", C.ascii_percent(C.latin(F.col("text").cast("binary"), 1, 256)).alias("percent"))


@query("SELECT doc_id, length(regexp_replace(s, '[\\x09-\\x0d\\x20-\\x7e]|[\\x{c2}-\\x{df}][\\x{80}-\\x{bf}]|[\\x{e0}-\\x{ef}][\\x{80}-\\x{bf}]{2}|[\\x{f0}-\\x{f4}][\\x{80}-\\x{bf}]{3}', '', 'g')) AS invalid FROM (SELECT doc_id, " + LATIN.format(t="text", n=256) + " AS s FROM documents)")
def utf8_validity(spark, d):
    return table(spark, d, "documents").select("doc_id", C.invalid_bytes(C.latin(F.col("text").cast("binary"), 1, 256)).alias("invalid"))


@query("SELECT doc_id, CASE WHEN regexp_matches(s, '[\\x09-\\x0d\\x20-\\x7e]{12,}') THEN length(regexp_extract(s, '^((?s).*?)[\\x09-\\x0d\\x20-\\x7e]{12,}', 1)) + 1 ELSE 0 END AS at_char FROM (SELECT doc_id, " + LATIN.format(t="substr(text, 3)", n=256) + " AS s FROM documents)")
def text_run(spark, d):
    return table(spark, d, "documents").select("doc_id", C.text_run(F.expr("cast(substr(text, 3) AS binary)")).alias("at_char"))


@query("""SELECT doc_id, regexp_matches(hex(encode(text)), '^((00)*|(FF)*)$') AS noise FROM documents
UNION ALL SELECT -1 - doc_id, regexp_matches(repeat('00', (doc_id % 50)::INT) || CASE WHEN doc_id % 3 = 0 THEN '41' ELSE '' END, '^((00)*|(FF)*)$') FROM documents WHERE doc_id % 10 = 0""")
def noise_filter(spark, d):
    """The whole text of every document, and made-up blobs of zeros, some with a letter behind them."""
    docs = table(spark, d, "documents")
    made = F.unhex(F.concat(F.repeat(F.lit("00"), F.expr("cast(doc_id % 50 AS int)")), F.when(F.col("doc_id") % 3 == 0, "41").otherwise("")))
    zeros = docs.where("doc_id % 10 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), C.is_noise(made).alias("noise"))
    return docs.select("doc_id", C.is_noise(F.col("text").cast("binary")).alias("noise")).unionByName(zeros)


@query(r"""WITH p AS (SELECT page_id, 'f' || page_id || CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.txt' ELSE '' END AS name, CASE page_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' END AS found FROM pages)
SELECT page_id, CASE WHEN found IS NULL OR lower(regexp_extract(name, '\.([^./]+)$', 1)) = found OR (found = 'jpg' AND lower(regexp_extract(name, '\.([^./]+)$', 1)) = 'jpeg') THEN name ELSE regexp_replace(name, '\.[^./]*$', '') || '.' || found END AS name FROM p""")
def ext_correction(spark, d):
    p = F.col("page_id")
    name = F.concat(F.lit("f"), p.cast("string"), F.when(p % 4 == 0, ".jpg").when(p % 4 == 1, ".JPEG").when(p % 4 == 2, ".txt").otherwise(""))
    content = F.when(p % 3 == 0, F.unhex(F.lit("FFD8FFE000104A464946"))).when(p % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A0000"))).otherwise(F.unhex(F.lit("00112233445566778899")))
    return table(spark, d, "pages").select("page_id", C.correct_extension(name, content).alias("name"))


# ---- scalars -------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split('/../' || url || '/./x' || chr(1) || '/', '/'), lambda p: regexp_replace(p, '[\x00-\x1f\x7f]', '', 'g')), lambda p: p NOT IN ('', '.', '..')), '/') AS path FROM pages")
def sanitize_path(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitize_path(F.concat(F.lit("/../"), F.col("url"), F.lit("/./x\x01/"))).alias("path"))


@query("SELECT o_orderkey, CASE WHEN n < 100000 THEN n::VARCHAR ELSE format('{:,}', n) END AS text FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 7) AS n FROM orders)")
def fmt_num(spark, d):
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 7)
    return table(spark, d, "orders").select("o_orderkey", X.format_count(n).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n / 1024.0)::DECIMAL(20,2) || ' KiB' WHEN n < 1073741824 THEN (n / 1048576.0)::DECIMAL(20,2) || ' MiB'
WHEN n < 1099511627776 THEN (n / 1073741824.0)::DECIMAL(20,2) || ' GiB' ELSE (n / 1099511627776.0)::DECIMAL(20,2) || ' TiB' END AS text FROM (SELECT o_orderkey, o_orderkey << (o_custkey % 38)::INT AS n FROM orders)""")
def fmt_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_size(F.expr("shiftleft(o_orderkey, cast(o_custkey % 38 AS int))")).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' END AS text
FROM (SELECT o_orderkey, o_orderkey * (o_custkey % 29) // 3 AS s FROM orders)""")
def fmt_time(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_duration(F.expr("o_orderkey * (o_custkey % 29) div 3")).alias("text"))


@query(r"""SELECT o_orderkey, CASE WHEN regexp_extract(t, '^\s*([0-9]*\.?[0-9]+)', 1) = '' THEN 0 ELSE trunc(regexp_extract(t, '^\s*([0-9]*\.?[0-9]+)', 1)::DOUBLE * CASE upper(regexp_extract(t, '^\s*[0-9]*\.?[0-9]+\s*([A-Za-z])', 1)) WHEN 'K' THEN 1024.0::DOUBLE WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0 ELSE 1.0 END)::BIGINT END AS bytes
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_custkey / 4.0) || 'k' WHEN 1 THEN o_custkey || ' MB' WHEN 2 THEN '-' || o_custkey WHEN 3 THEN 'x' WHEN 4 THEN o_custkey || 'q' ELSE '.5G' END AS t FROM orders)""")
def parse_size(spark, d):
    c = F.col("o_custkey")
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, F.concat((c / 4.0).cast("string"), F.lit("k"))).when(k == 1, F.concat(c.cast("string"), F.lit(" MB"))).when(k == 2, F.concat(F.lit("-"), c.cast("string"))).when(k == 3, "x").when(k == 4, F.concat(c.cast("string"), F.lit("q"))).otherwise(".5G")
    return table(spark, d, "orders").select("o_orderkey", X.parse_size(t).alias("bytes"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def contains_ignoring_case(spark, d):
    return table(spark, d, "documents").where(X.contains_ignore_case(F.col("text"), "LICENSE")).select("doc_id")


@query("""SELECT o_orderkey, s > 0 AND s <= 800000000 + 63244800 AS valid, CASE WHEN s > 0 AND s <= 863244800 AND s >= 631152000 THEN s WHEN s - 500000000 > 0 AND s - 500000000 <= 863244800 THEN s - 500000000 ELSE 800000000 END AS created
FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 - (o_custkey % 3) * 400000000 AS s FROM orders)""")
def ts_validity(spark, d):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - (F.col("o_custkey") % 3) * 400_000_000
    ns, back = s * 1_000_000_000, (s - 500_000_000) * 1_000_000_000
    return table(spark, d, "orders").select("o_orderkey", X.valid_time(ns, 800_000_000).alias("valid"), X.creation_time(ns, back, 800_000_000).alias("created"))


@query("""SELECT o_orderkey, CASE WHEN (m & 4095) = 0 THEN 0 ELSE (m & 4095 & 1023) | CASE WHEN (m & 61440) = 16384 THEN 448 ELSE 384 END END AS mode, (m & 61440) = 16384 AS is_dir
FROM (SELECT o_orderkey, ((o_custkey * 37) % 65536)::INT AS m FROM orders)""")
def mode_clamp(spark, d):
    m = (F.col("o_custkey") * 37 % 65536).cast("int")
    return table(spark, d, "orders").select("o_orderkey", X.safe_mode(m, X.is_dir_mode(m)).alias("mode"), X.is_dir_mode(m).alias("is_dir"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber & 15)::BIGINT AS key_type, l_orderkey & ((1::BIGINT << 60) - 1) AS key_id, l_partkey AS length, (l_linenumber & 7)::INT AS flags FROM lineitem")
def bit_fields(spark, d):
    key = F.expr("shiftleft(cast(l_linenumber AS bigint), 60)").bitwiseOR(F.col("l_orderkey"))
    field = F.expr("shiftleft(cast(l_linenumber & 7 AS bigint), 56)").bitwiseOR(F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.key_type(key).alias("key_type"), X.key_id(key).alias("key_id"), X.extent_length(field).alias("length"), X.extent_flags(field).alias("flags"))


@query("SELECT p_partkey, (p_partkey + 7) & -8 AS to8, (p_partkey + 15) & -16 AS to16, (p_partkey + 4095) // 4096 AS blocks FROM part")
def align_up(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, X.align_up(k, 8).alias("to8"), X.align_up(k, 16).alias("to16"), X.ceil_div(k, 4096).alias("blocks"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, (epoch_us(ts) % 1000000) * 1000 + event_id % 1000 AS rest FROM events")
def ns_split(spark, d):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return table(spark, d, "events").select("event_id", X.ns_seconds(ns).alias("seconds"), X.ns_rest(ns).alias("rest"))


@query("SELECT p_partkey, upper(h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) AS uuid, printf('%o', p_partkey) AS octal FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def format_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.format_uuid(F.unhex(F.md5(F.col("p_name").cast("binary")))).alias("uuid"), X.octal(F.col("p_partkey")).alias("octal"))


# ---- audit ---------------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT doc_id) AS files, count(DISTINCT doc_id) FILTER (WHERE quality = 0) AS orphans, sum(n_chars)::BIGINT AS bytes FROM documents LEFT JOIN labels USING (doc_id)")
def scan_counts(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.countDistinct("doc_id").alias("files"), F.countDistinct(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("orphans"), F.sum("n_chars").alias("bytes"))


@query("SELECT count(*) AS found, count(*) FILTER (WHERE n_chars >= 200) AS recovered, count(*) FILTER (WHERE n_chars < 200) AS skipped, count(*) FILTER (WHERE n_chars = 0) AS zero_byte FROM documents")
def run_summary(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("found"), F.count_if(n >= 200).alias("recovered"), F.count_if(n < 200).alias("skipped"), F.count_if(n == 0).alias("zero_byte"))


@query("SELECT source, CASE WHEN count(*) > 0 THEN least(100.0, 100.0 * count(*) FILTER (WHERE n_chars >= 300) / count(*)) ELSE 0.0 END::DOUBLE AS percent FROM documents GROUP BY source")
def recovery_rate(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 300).alias("done"), F.count(F.lit(1)).alias("found"))
    return g.select("source", audit.recovery_percent(F.col("done"), F.col("found")).cast("double").alias("percent"))


@query("SELECT arg_min(found, run) AS found, sum(recovered)::BIGINT AS recovered, sum(skipped)::BIGINT AS skipped FROM (SELECT CASE WHEN o_orderdate < DATE '1995-06-01' THEN 1 ELSE 2 END AS run, count(*) AS found, count(*) FILTER (WHERE o_orderstatus = 'F') AS recovered, count(*) FILTER (WHERE o_orderstatus <> 'F') AS skipped FROM orders GROUP BY 1)")
def run_consolidation(spark, d):
    run = F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("date"), 1).otherwise(2)
    runs = table(spark, d, "orders").groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("o_orderstatus") == "F").alias("recovered"), F.count_if(F.col("o_orderstatus") != "F").alias("skipped"))
    return audit.consolidate(runs, ["found"], ["recovered", "skipped"])


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text"), 256).alias("sha"), "lang", "source")
    after = docs.where("source <> 'src3'").withColumn("sha", F.when(F.col("lang") == "de", F.concat("sha", F.lit("x"))).otherwise(F.col("sha")))
    return docs.where("source <> 'src5'"), after


SNAP = "WITH s AS (SELECT doc_id AS path, sha256(text) AS sha, lang, source FROM documents), a AS (SELECT * FROM s WHERE source <> 'src5'), b AS (SELECT path, CASE WHEN lang = 'de' THEN sha || 'x' ELSE sha END AS sha FROM s WHERE source <> 'src3')"


@query(SNAP + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha <> b.sha")
def snapshot_diff(spark, d):
    return audit.snapshot_diff(*_snapshots(spark, d), "path", "sha")


@query(SNAP + " SELECT path FROM a EXCEPT SELECT path FROM b")
def ids_except(spark, d):
    a, b = _snapshots(spark, d)
    return a.select("path").exceptAll(b.select("path"))


@query(SNAP + " SELECT a.path, CASE WHEN b.path IS NULL THEN 'MISSING' WHEN a.sha = b.sha THEN 'OK' ELSE 'FAILED' END AS result FROM a LEFT JOIN b ON a.path = b.path")
def manifest_verify(spark, d):
    return audit.verify_manifest(*_snapshots(spark, d), "path", "sha")


@query("SELECT DISTINCT event_id * 10 // n AS tenth FROM events, (SELECT max(event_id) + 1 AS n FROM events)")
def progress_snapshots(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id").crossJoin(F.broadcast(e.agg((F.max("event_id") + 1).alias("n")))).select(F.expr("event_id * 10 div n").alias("tenth")).distinct()


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents")
def tree_totals(spark, d):
    return audit.tree_totals(table(spark, d, "documents"), "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice, l_shipdate) AS place FROM lineitem QUALIFY place <= 3")
def limit_per_group(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "place")
