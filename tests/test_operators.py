import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gneiss.functions import scalars as X
from gneiss.operators import relations, stats, worklist
from gneiss.plans import catalog

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_formats(spark):
    lit = lambda v: F.lit(v).cast("long")
    assert one(spark, *[X.format_count(lit(v)) for v in (0, 99_999, 100_000, 1_234_567)]) == ("0", "99999", "100,000", "1,234,567")
    assert one(spark, *[X.format_size(lit(v)) for v in (0, 1023, 1536, 5 << 20, 3 << 30, 2 << 40)]) == ("0 B", "1023 B", "1.50 KiB", "5.00 MiB", "3.00 GiB", "2.00 TiB")
    assert one(spark, *[X.format_duration(lit(v)) for v in (0, 45, 185, 3900, 183_600)]) == ("0s", "45s", "3m 05s", "1h 5m", "2d 3h")
    assert one(spark, *[X.parse_size(F.lit(v)) for v in ("1.5G", "10k", "7 M", "3", "x", "-5", "2q")]) == (int(1.5 * 2**30), 10240, 7 << 20, 3, 0, 0, 2)


def test_paths(spark):
    assert one(spark, *[X.sanitize_path(F.lit(v)) for v in ("/a//b/./../c", "a\x01/\x7f/b", ".\x01./x", "///")]) == ("a/b/c", "a/b", "x", "")
    assert one(spark, *[X.suffix_before_extension(F.lit(v), "_X") for v in ("d/a.txt", "a", ".hidden", "d.e/f", "a.b.c")]) == ("d/a_X.txt", "a_X", ".hidden_X", "d.e/f_X", "a.b_X.c")


def test_bits_and_times(spark):
    key = (9 << 60 | 77) - (1 << 64)
    assert one(spark, X.key_type(F.lit(key)), X.key_id(F.lit(key)), X.align_up(F.lit(9).cast("long"), 8)) == (9, 77, 16)
    assert one(spark, X.ns_seconds(F.lit(-1).cast("long")), X.ns_rest(F.lit(-1).cast("long"))) == (-1, 999_999_999)
    ns = lambda s: F.lit(s * 10**9).cast("long")
    assert one(spark, X.creation_time(ns(700_000_000), ns(5), 800_000_000), X.creation_time(ns(5), ns(9), 800_000_000), X.creation_time(ns(-5), ns(9_000_000_000), 800_000_000)) == (700_000_000, 9, 800_000_000)
    assert one(spark, X.safe_mode(F.lit(0o104755), F.lit(False)), X.safe_mode(F.lit(0o040000), F.lit(True)), X.safe_mode(F.lit(0o040007), F.lit(True))) == (0o755, 0, 0o707)


def test_collisions(spark):
    df = spark.createDataFrame([("p.x", i, 9 - i) for i in range(4)] + [("q", 9, None)], "path string, inode_id long, first_phys long")
    got = {r.inode_id: r.actual_path for r in worklist.collision_names(df).collect()}
    assert got == {3: "p.x", 2: "p_COLLISION.x", 1: "p_COLLISION_2.x", 0: "p_COLLISION_3.x", 9: "q"}


@pytest.mark.parametrize("values, shape", [([100, 101, 102, 103] * 5, "tight"), ([1, 2, 3, 1000, 1001, 1002], "two states"), ([*range(1, 40), 5000], "thin top"), (list(range(1, 2000)), "gradual")])
def test_advice(spark, values, shape):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    r = stats.advise_cutoff(df, "x").first()
    assert r.shape == shape
    if shape == "two states":
        assert r.cutoff == 1000 and r.n_above == 3


def test_percentiles_are_elements(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 9, 3, 3)] + [(None,)], "x long")
    assert {r.p: r.value for r in stats.index_percentiles(df, "x", [0, 50, 99, 100]).collect()} == {0: 1, 50: 3, 99: 9, 100: 9}


def test_merge_order(spark):
    df = spark.createDataFrame([(1, 1, 0, "a", 5), (1, 2, 0, None, 0), (1, 3, 0, "c", None)], "k int, block_num long, ord int, s string, n int")
    (r,) = relations.merge_last(df, "k", ["block_num", "ord"], {"s": F.col("s").isNotNull(), "n": F.col("n").isNotNull()}).collect()
    assert (r.s, r.n) == ("c", 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["extent_cow_latest", "drec_dedupe_known_parent", "path_resolve", "xid_advice", "xid_gap", "inode_last_writer", "collision_suffix", "content_dedup", "classify_pages", "ts_validity", "snapshot_diff"])
def test_catalogue_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda rows: sorted(repr(tuple(str(v) for v in r)) for r in rows)
    assert norm(got.select(*columns).collect()) == norm(want.select(*columns).fetchall())


def test_entry_without_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/gneiss", tmp_path / "gneiss", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=100).returncode == 0


def test_duplicates_are_equal_to_the_last_byte(spark, tmp_path):
    head = "x" * 65_536
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, "short"), (5, "shorT")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.size, r.copies, r.kept, r.redundant) for r in catalog.QUERIES["dup_groups"](spark, str(tmp_path)).collect()] == [(65_537, 2, 1, 1)]
    assert tuple(catalog.QUERIES["dup_redundant"](spark, str(tmp_path)).first()) == (1, 1)
    assert catalog.QUERIES["content_dedup"](spark, str(tmp_path)).count() == 3  # the signature of 64 KB, as it was


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["dup_groups", "dup_redundant"])
def test_duplicates_match_sql(spark, name):
    test_catalogue_matches_sql(spark, name)
