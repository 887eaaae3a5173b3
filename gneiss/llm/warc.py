"""WARC records, and the resolution of not-modified revisits to the full responses they stand for."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import read_table

#: Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)"
#: Longer header lines are read in parts.
LINE = 1 << 16
#: Header fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """One form for the addresses of one resource.

    Scheme, ``www.``, default ports, fragment, tracking parameters and slashes at the end of the path go; the
    host is lower-cased and the remaining parameters are sorted. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def weak_etag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame, slices: int | None = None, full: tuple[int, ...] = (200,)) -> DataFrame:
    """For every revisit capture, the latest earlier full response of its canonical URL.

    ``captures``: ``record_id long, url string, ts long, kind string ('response' or 'revisit'), status int, profile
    string, etag string, last_modified string, payload_digest string, headers map<string,string>`` (names in lower
    case). A full response has one of the statuses ``full``; others (errors, parts, null) are never resolved to. A
    revisit is a not-modified one if its profile is null or names ``server-not-modified``.
    Results, one row per revisit: ``record_id, url, canonical, ts, status, response_id, payload_digest, headers``.
    ``status`` is ``resolved`` (the entity tags agree in the weak comparison or, without a tag, the dates of
    last modification), ``unverified`` (the revisit carries no validator), ``mismatch``, ``missing`` (no
    earlier full response, null url or null time) or ``other_profile``; the last three have null results and their own
    headers. Headers of the others are the response's, with the permitted fields of the revisit laid over them.

    Earlier means a smaller (ts, record_id). The as-of join runs in two steps so that one URL may hold a third of
    all captures: time is cut into ``slices`` by quantiles (by default one for a million captures, 64 to 4096), each
    (URL, slice) finds its own latest response, and revisits before the first response of their slice take the last
    one of the earlier slices, of which there is one row per URL and slice. Captures of other kinds are ignored, as
    are other columns; repeated records are answered each; an empty table gives an empty result; only the narrow
    columns named above are moved.
    """
    known = captures.where(F.col("kind").isin("response", "revisit")).withColumn("canonical", canonical_url(F.col("url")))
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    if slices is None:
        slices = min(4096, max(64, -(-known.count() // 1_000_000)))
    cuts = known.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], max(1000, 4 * slices)).alias("q")).first().q if slices > 1 else None
    edges = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    events = known.where(usable).withColumn("_slice", F.size(F.filter(edges, lambda e: e < F.col("ts"))))
    whole = (F.col("kind") == "response") & F.col("status").isin(*full)
    seen = F.when(whole, F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", "headers"))
    before = Window.partitionBy("canonical", "_slice").orderBy("ts", F.col("record_id").asc_nulls_first(), F.when(F.col("kind") == "response", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("_full", F.last(seen, ignorenulls=True).over(before)).where("kind = 'revisit'")
    ends = events.where(whole).groupBy("canonical", "_slice").agg(F.max_by(F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", "headers"), F.struct("ts", "record_id")).alias("_end"))
    marks = ends.unionByName(events.where("kind = 'revisit'").select("canonical", "_slice").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    marks = marks.groupBy("canonical", "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    found = near.join(carried, ["canonical", "_slice"], "left").withColumn("_r", F.coalesce("_full", "_carried"))
    lost = known.where(~usable & (F.col("kind") == "revisit"))
    found = found.unionByName(lost, allowMissingColumns=True)
    tag, date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    agrees = F.when(tag, weak_etag(F.col("etag")).eqNullSafe(weak_etag(F.col("_r.etag")))).otherwise(F.col("last_modified").eqNullSafe(F.col("_r.last_modified")))
    other = ~F.coalesce(F.col("profile").contains("server-not-modified"), F.lit(True))
    status = F.when(other, "other_profile").when(F.col("_r").isNull(), "missing").when(~tag & ~date, "unverified").when(agrees, "resolved").otherwise("mismatch")
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    base = F.map_filter(F.coalesce("_r.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(fresh, k))
    good = F.col("status").isin("resolved", "unverified")
    return found.withColumn("status", status).select(
        "record_id", "url", "canonical", "ts", "status",
        F.when(good, F.col("_r.record_id")).alias("response_id"),
        F.when(good, F.col("_r.payload_digest")).alias("payload_digest"),
        F.when(good, F.map_concat(base, fresh)).otherwise(own).alias("headers"),
    )


class Members(io.RawIOBase):
    """The content of a gzip file, member by member and in bounded steps; it ends at the first broken member."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.member, self.out = raw, 0, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.out:
            if self.member is None:
                if self.raw[self.at : self.at + 2] != b"\x1f\x8b":
                    return 0
                self.member = zlib.decompressobj(31)
            piece = self.member.unconsumed_tail
            if not piece:
                piece = self.raw[self.at : self.at + LINE]
                self.at += len(piece)
            try:
                self.out = self.member.decompress(piece, LINE)
            except zlib.error:
                self.at, self.member = len(self.raw), None
                return 0
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = None
            elif not piece and not self.out:
                return 0
        n = min(len(buffer), len(self.out))
        buffer[:n], self.out = self.out[:n], self.out[n:]
        return n


def parse_warc(raw: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped by record, one after another: gzip members are opened one at a time.

    A record without a length, or with one that is no number or negative, is left out and reading goes on at the next
    line that starts a record. A truncated last record and what follows a broken gzip member are left out.
    """
    stream = io.BufferedReader(Members(raw) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
    while line := stream.readline(LINE):
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline(LINE)) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            continue
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        yield {"fields": fields, "block": block}


def write_warc(records: list[dict], compress: bool = True) -> bytes:
    """The file for ``parse_warc``: records as (fields, block), each its own gzip member if compressed."""
    out = []
    for r in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in (r["fields"] | {"content-length": str(len(r["block"]))}).items())
        one = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + r["block"] + b"\r\n\r\n"
        out.append(gzip.compress(one, mtime=0) if compress else one)
    return b"".join(out)


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, header fields (lower-case names) and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("iso-8859-1").split("\r\n")
    words = first.split(" ")
    fields = {}
    for line in rest:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return int(words[1]) if len(words) > 1 and words[1].isdigit() else None, fields, body


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 16_000_000) -> DataFrame:
    """Captures of all WARC files below ``path``, in the form that ``resolve_revisits`` takes, and their ``body``.

    Files are read by Spark's binaryFile source, one compressed file per row, so a file must fit into a worker's
    memory as it is stored; its records are decompressed one at a time and handed on in batches of about ``batch_bytes``.
    Records other than response and revisit are left out; ``record_id`` is a hash of the WARC-Record-ID; a date
    that cannot be read is null. Malformed records: as in ``parse_warc``; empty files give nothing.
    """
    schema = "record_id long, url string, ts long, kind string, status int, profile string, etag string, last_modified string, payload_digest string, headers map<string,string>, body binary"
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    names = ["record_id", "url", "ts", "kind", "status", "profile", "etag", "last_modified", "payload_digest", "headers", "body"]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        status, headers, body = split_http(block)
        try:
            ts = int(dt.datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).timestamp() * 1_000_000)
        except (KeyError, ValueError):
            ts = None
        key = xxhash.xxh64_intdigest(fields.get("warc-record-id", "").encode()) >> 1
        return key, fields.get("warc-target-uri"), ts, fields["warc-type"], status, fields.get("warc-profile"), headers.get("etag"), headers.get("last-modified"), fields.get("warc-payload-digest"), list(headers.items()), body

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    def records(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for r in parse_warc(batch.column(0)[k].as_py() or b""):
                    if r["fields"].get("warc-type") in ("response", "revisit"):
                        rows.append(row(r["fields"], r["block"]))
                        held += len(r["block"])
                    if held > batch_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, schema)


def crawl_log(pages: DataFrame) -> DataFrame:
    """A capture log over a table of pages: each page is fetched once in full and asked for again once.

    The full response of page p is record 2p. Record 2p + 1 is its revisit, made under another spelling of the
    address. By page number, some revisits precede their response (p mod 7 = 0), some carry an outdated tag
    (p mod 5 = 0), only a date (p mod 5 = 1) or no validator (p mod 5 = 2). Some first fetches are errors or parts
    (p mod 11 = 0 and 1), some revisits have another profile (p mod 13 = 0). A null page number gives null ids and
    times; repeated pages give repeated records; other columns are ignored; an empty table gives an empty log.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    date = F.concat(F.lit("day "), (p % 365).cast("string"))
    start = F.lit(1_700_000_000) + p * 60
    full = pages.select(
        (p * 2).alias("record_id"), "url", start.alias("ts"), F.lit("response").alias("kind"), F.when(p % 11 == 0, 404).when(p % 11 == 1, 206).otherwise(200).alias("status"), F.lit(None).cast("string").alias("profile"), digest.alias("etag"), date.alias("last_modified"), digest.alias("payload_digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), digest, F.lit("date"), start.cast("string"), F.lit("last-modified"), date).alias("headers"),
    )
    again = start + F.when(p % 7 == 0, F.lit(-86_400)).otherwise(F.lit(86_400))
    tag = F.when(p % 5 == 0, F.lit("outdated")).when(p % 5 >= 3, F.concat(F.lit("W/"), digest))
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.concat(F.lit("http://netpreserve.org/warc/1.1/revisit/"), F.when(p % 13 == 0, "identical-payload-digest").otherwise("server-not-modified")).alias("profile"), tag.alias("etag"), F.when(p % 5 == 1, date).alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"),
        F.create_map(F.lit("date"), again.cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(revisit)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the log over all pages; odd rows as in ``crawl_log`` and ``resolve_revisits``."""
    found = resolve_revisits(crawl_log(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "canonical", "ts", "status", "response_id", "payload_digest", merged.alias("headers"))


OP6_SQL = r"""
WITH c AS (
  SELECT page_id * 2 AS record_id, url, 1700000000 + page_id * 60 AS ts, 0 AS late, md5(coalesce(html, '')) AS etag, 'day ' || (page_id % 365) AS last_modified, page_id FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, url || '#again', 1700000000 + page_id * 60 + CASE WHEN page_id % 7 = 0 THEN -86400 ELSE 86400 END, 1,
    CASE WHEN page_id % 5 = 0 THEN 'outdated' WHEN page_id % 5 >= 3 THEN 'W/' || md5(coalesce(html, '')) END, CASE WHEN page_id % 5 = 1 THEN 'day ' || (page_id % 365) END, page_id FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS parts FROM b),
n AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical FROM q),
w AS (
  SELECT *, last_value(CASE WHEN late = 0 AND page_id % 11 > 1 THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, record_id, late ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM n),
j AS (
  SELECT w.record_id, w.canonical, w.ts, r.record_id AS rid, r.etag AS retag, r.last_modified AS rdate, r.ts AS rts,
    CASE WHEN w.page_id % 13 = 0 THEN 'other_profile' WHEN r.record_id IS NULL THEN 'missing' WHEN w.etag IS NULL AND w.last_modified IS NULL THEN 'unverified'
      WHEN w.etag IS NOT NULL THEN CASE WHEN regexp_replace(w.etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN w.last_modified = r.last_modified THEN 'resolved' ELSE 'mismatch' END AS status
  FROM w LEFT JOIN c r ON r.record_id = w.rid AND r.late = 0 WHERE w.late = 1)
SELECT record_id, canonical, ts, status, CASE WHEN status IN ('resolved', 'unverified') THEN rid END AS response_id, CASE WHEN status IN ('resolved', 'unverified') THEN retag END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified')
    THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || retag || chr(10) || 'last-modified: ' || rdate
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END AS headers
FROM j
"""
