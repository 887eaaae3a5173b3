import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gneiss.llm.exact_dedup import exact_dedup
from gneiss.llm.sharding import interleave


def brute_exact(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows]
    ids = defaultdict(list)
    for r, n in zip(rows, norm):
        ids[n].append(r[0])
    out = []
    for r, n in zip(rows, norm):
        known = [i for i in ids[n] if i is not None]
        keep = min(known) if known else None
        out.append((r[0], keep, len(ids[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_matches_brute_force(odd, odd_rows, clashing, rows_of):
    want = brute_exact(odd_rows)
    assert rows_of(exact_dedup(odd)) == want
    assert rows_of(exact_dedup(clashing, runs=5)) == want
    assert rows_of(exact_dedup(odd, runs=1)) == want


def test_exact_dedup_hot_group(spark, rows_of):
    rows = [(i, "same  text" if i % 3 else f"text {i}", None, None, None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(exact_dedup(df)) == brute_exact(rows)


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_merges_sorted_runs_without_python(odd):
    plan = exact_dedup(odd, runs=32)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("REPARTITION_BY_COL") == 5 and "HashAggregate" not in plan  # log2(32) rounds, each sorted and merged


def test_exact_dedup_result_does_not_depend_on_runs(odd, rows_of):
    assert rows_of(exact_dedup(odd, runs=2)) == rows_of(exact_dedup(odd.repartition(7), runs=64))


def test_shards_match_the_mixture(odd, odd_rows, clashing):
    for docs in (odd, clashing):
        got = interleave(docs, shards=4).collect()
        assert len(got) == len(odd_rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        sizes = [len(v) for v in by.values()]
        assert max(sizes) - min(sizes) <= 1 and set(by) == {0, 1, 2, 3}
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        total = Counter(r[3] for r in odd_rows)
        for own in by.values():
            for source, n in Counter(r.source for r in own).items():
                assert abs(n - total[source] / 4) <= 1 + len(total)


def test_shards_do_not_depend_on_partitions(odd, rows_of):
    once = rows_of(interleave(odd).where("doc_id <> 6"))
    assert rows_of(interleave(odd.repartition(7)).where("doc_id <> 6")) == once


def test_shards_of_nothing_and_of_few_rows(spark, empty):
    assert interleave(empty).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], empty.schema)
    assert [(r.shard, r.slot, r.size) for r in interleave(one).collect()] == [(0, 0, 1)]


def test_one_hot_source(spark, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = interleave(docs, shards=8).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "hot").alias("hot")).collect()
    assert {r.n for r in got} == {375} and all(abs(r.hot - 362.5) <= 2 for r in got)
