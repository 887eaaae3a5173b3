"""Line dedup: hashes of lines, range-partitioned and sorted by document and position, answered by keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, shuffle_partitions, slices, small_batches

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without white space at its ends and with A-Z lower-cased; None if shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or len(key.translate(None, CONTINUATION)) < min_chars:
        return None
    return key.translate(LOWER)


def _rank(doc) -> tuple:
    return (doc is not None, doc)


def _mark(text: Column) -> Column:
    """Tells rows of one repeated id apart when bitmaps are joined back."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A compressed keep bitmap for each document that loses lines: ``doc_id, text_mark, n_lines, n_dropped, keep_bitmap``.

    Lines whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents are
    dropped from all documents but the one with the largest id, where all of them stay. Only 16-byte hashes,
    ids and positions are moved. Hashes are uniform, so equal ranges of them are equal partitions; each is
    sorted by hash, falling id and first position (one row holds all positions of a hash in a document), so the
    first document of a hash is its keeper and the rest streams by. Within a batch of documents a hash in ``min_docs`` of them is settled at once and passes on its largest
    document only, so a line found in a third of all documents is a few rows per batch.
    """
    kind = dict(small_batches(docs).dtypes)[id_col]
    ranges = shuffle_partitions(docs.sparkSession)
    schema = f"part int, digest binary, doc_id {kind}, text_mark long, n_lines int, places array<int>, weight int"

    def spread(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: dict[bytes, dict] = {}
            lines_of = []
            for row, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                lines = (raw or b"").split(b"\n")
                lines_of.append(len(lines))
                for pos, line in enumerate(lines):
                    if (key := line_key(line, min_chars)) is not None:
                        held.setdefault(xxhash.xxh3_128_digest(key), {}).setdefault(ids[row], {}).setdefault(row, []).append(pos)
            out = []
            for digest, by_doc in held.items():
                part = int.from_bytes(digest[:4], "big") * ranges >> 32
                many = len(by_doc) >= min_docs
                top = max(by_doc, key=_rank) if many else None
                for doc, by_row in by_doc.items():
                    for row, places in by_row.items():
                        if not many or doc == top:
                            out.append((part, digest, row, places, min_docs if many else 1))
                        else:  # settled: dealt by the id, as the answer is all that is still needed
                            out.append((xxhash.xxh32_intdigest(str(doc)) % ranges, None, row, places, 0))
            part, digest, row, places, weight = zip(*out) if out else ((),) * 5
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(digest, pa.binary()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.array(lines_of, np.int32)[row], pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(weight, pa.int32())],
                names=["part", "digest", "doc_id", "text_mark", "n_lines", "places", "weight"],
            )

    def stream(batches):
        digest, keeper, last, found, waiting = None, None, None, 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (1, 2, 6)]
            drop = []
            late: list[dict] = []
            for i, (d, doc, weight) in enumerate(zip(*columns)):
                if d is None:
                    drop.append(i)
                    continue
                if d != digest:
                    digest, keeper, last, found, waiting = d, doc, doc, weight, []
                    continue
                if doc != last:
                    last = doc
                    found += weight
                elif weight > 1:
                    found = max(found, weight)
                if doc == keeper:
                    continue
                if found >= min_docs:
                    drop.append(i)
                    late += waiting
                    waiting = []
                else:
                    waiting.append({k: batch.column(k)[i] for k in ("doc_id", "text_mark", "n_lines", "places")})
            if late:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in late], t) for k, t in (("doc_id", batch.column(2).type), ("text_mark", pa.int64()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32())))], names=["doc_id", "text_mark", "n_lines", "places"])
            yield batch.select(["doc_id", "text_mark", "n_lines", "places"]).take(pa.array(drop, pa.int64()))

    def pack(batches):
        for batch in batches:
            maps, dropped = [], []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, bool)
                keep[places] = False
                dropped.append(n - int(keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_mark", "n_lines", "n_dropped", "keep_bitmap"])

    rows = docs.select(F.col(id_col), _mark(F.col(text_col)), F.col(text_col).cast("string")).mapInArrow(spread, schema)
    placed = rows.repartitionById(ranges, F.col("part")).sortWithinPartitions(F.col("digest"), F.col("doc_id").desc_nulls_last(), F.col("places")[0])
    drops = placed.mapInArrow(stream, f"doc_id {kind}, text_mark long, n_lines int, places array<int>")
    by_doc = drops.groupBy("doc_id", "text_mark", "n_lines").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return by_doc.mapInArrow(pack, f"doc_id {kind}, text_mark long, n_lines long, n_dropped long, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and ``_keep``: the bitmap of the row, null where all lines stay."""
    marked = docs.withColumn("_mark", _mark(F.col(text_col)))
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_text_mark"), F.col("keep_bitmap").alias("_keep"))
    return marked.join(maps, marked[id_col].eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_text_mark")), "left").drop("_mark", "_id", "_text_mark")


def kept_text(raw: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, the kept lines joined by a line feed)."""
    raw = raw or b""
    if keep is None:
        return raw.count(b"\n") + 1, 0, raw
    lines = raw.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [line for line, bit in zip(lines, bits.tolist()) if bit]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from the text: all other columns, rows and their count stay.

    A null or empty text is one empty line and stays as it is. Rows that repeat an id are one document when
    documents are counted, and each keeps or loses its own lines; a null id is smaller than all others. Columns
    starting with an underscore are reserved. An empty table gives an empty result.
    """
    schema = docs.schema
    at = schema.names.index(text_col)

    def rebuild(batches):
        for batch in slices(batches):
            raws, keeps = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(schema)).to_pylist()
            texts = [r if k is None else kept_text(r, k)[2] for r, k in zip(raws, keeps)]
            columns = [batch.column(i) for i in range(len(schema))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    joined = with_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
    return joined.select(*[joined[c] for c in schema.names], "_keep").mapInArrow(rebuild, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")

    def digest(batches):
        for batch in slices(batches):
            found = [kept_text(r, k) for r, k in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return with_bitmaps(docs, line_bitmaps(docs)).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id < g.keeper AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
