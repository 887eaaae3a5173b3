"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables are treated as the docstrings of the
operators say: a text without words fails the quality rules; rows that repeat an id are one document; a null id comes
before (line dedup) or after (near and substring dedup) all others. Columns beyond those of documents are dropped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm import line_dedup, near, packing, quality, substring_dedup
from gneiss.llm.common import materialise, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the rest stay as they are."""
    return quality.keep_good(docs.select(*COLUMNS), quality.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one document only."""
    return _counted(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles and more) the document with the smallest id stays."""
    return near.keep_first(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id has too go."""
    return _counted(substring_dedup.dedup_substrings(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in a length bucket and a batch."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("substring dedup", substring_stage), ("packing", packing_stage)]
#: The line chain, fingerprint components and the bucket boundaries have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each on what its predecessor wrote; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
