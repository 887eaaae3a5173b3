"""Every registered query of the subpackage, on tables with odd rows and extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from gneiss.llm import catalog

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def folder(spark, clashing, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    clashing.write.parquet(str(at / "documents.parquet"))
    labels = [(5, 1, 0), (13, 1, None), (4, 0, 0), (9, 0, 1), (None, 1, 0), (14, None, 0), (5, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lines", F.lit(1)).write.parquet(str(at / "labels.parquet"))
    pages = [(1, "http://a.org/x?b=1", "<article><p>Some words of an article.</p></article>"), (2, None, None), (None, "x", ""), (1, "http://a.org/x?b=1", "<p>again</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("status", F.lit("x")).withColumn("text", F.lit(3)).write.parquet(str(at / "pages.parquet"))
    return str(at)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_odd_rows(spark, folder, odd_rows, name):
    if name == "op1_sentencepiece" and not os.path.exists(MODEL):
        pytest.skip("no model file here")
    got = catalog.QUERIES[name](spark, folder).collect()
    if name in ("op6_warc_revisits", "op9_html_extraction"):
        assert len(got) == 4
        return
    ids = sorted((r.doc_id for r in got), key=repr)
    want = sorted((r[0] for r in odd_rows), key=repr)
    assert (sorted(set(ids), key=repr) == sorted(set(want), key=repr)) if name == "op3_packing" else ids == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
