import corpus_pipeline
from test_lines_and_substrings import brute_lines, brute_substrings
from test_near import brute_groups

from gneiss.llm import quality


def test_stages_match_brute_force(spark, odd, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (6, 15)]
    docs = spark.createDataFrame(rows, odd.schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def run(k, have):
        out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(have, odd.schema), str(tmp_path))
        assert out.columns == docs.columns
        return sorted((tuple(r) for r in out.collect()), key=repr)

    def counted(r, text):
        return (r[0], text, r[2], r[3], None if text is None else len(text))

    have = rows
    good = sorted((r for r in have if (c := quality.base_counts((r[1] or "").encode()))[0] >= 10 and 100 * c[4] <= 20 * c[0]), key=repr)
    assert (have := run(0, have)) == good
    new = brute_lines(have)
    assert (got := run(1, have)) == sorted((counted(r, t) for r, t in zip(have, new)), key=repr)
    have = got
    first = set(brute_groups(have).values())
    assert (got := run(2, have)) == [r for r in have if r[0] in first]
    have = got
    want = [counted(r, r[1] if not n else " ".join(w)) for r, (_, n, w) in zip(have, brute_substrings(have))]
    assert (got := run(3, have)) == sorted(want, key=repr)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in got}


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
