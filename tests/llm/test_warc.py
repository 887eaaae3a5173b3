import gzip
import random

from gneiss.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>, status int, profile string, body string, canonical string"


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/?b=2&a=1#x", "https://example.com:443/a?a=1&b=2&utm_source=z", "example.com/a?ref=q&a=1&b=2"]
    other = ["http://example.com", "http://example.com/A", None, ""]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r.c for r in df.select(warc.canonical_url(df.u).alias("c")).collect()]
    assert set(got[:3]) == {"example.com/a?a=1&b=2"} and got[3:] == ["example.com", "example.com/A", None, ""]


def brute(rows):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [x for x in rows if x[3] == "response" and x[8] == 200 and x[1] is not None and x[1] == r[1] and x[2] is not None and r[2] is not None and (x[2], x[0]) < (r[2], r[0])]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        if r[9] is not None and "server-not-modified" not in r[9]:
            status = "other_profile"
        elif best is None:
            status = "missing"
        elif r[4] is None and r[5] is None:
            status = "unverified"
        elif r[4] is not None:
            status = "resolved" if best[4] is not None and r[4].removeprefix("W/") == best[4].removeprefix("W/") else "mismatch"
        else:
            status = "resolved" if r[5] == best[5] else "mismatch"
        good = status in ("resolved", "unverified")
        merged = {**best[7], **{k: v for k, v in r[7].items() if k in warc.PERMITTED}} if good else r[7]
        out.append((r[0], status, best[0] if good else None, best[6] if good else None, sorted(merged.items())))
    return sorted(out, key=repr)


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(0)
    rows = []
    for i in range(500):
        kind = rng.choice(("response", "revisit", "request"))
        url = rng.choice(("h.com/hot",) * 3 + (f"h.com/{i % 9}", None))
        tag = rng.choice((None, "a", "b", "W/a"))
        date = rng.choice((None, "m1", "m2"))
        head = {"etag": tag or "none", "date": str(i), "content-type": "x"} if kind == "response" else {"date": str(i), "content-length": "0"}
        rows.append((i, url, rng.choice((None, *range(40))), kind, tag, date, f"d{i}", head, rng.choice((200, 200, 200, 404, 206, None)), rng.choice((None, "x/server-not-modified", "x/server-not-modified", "x/identical-payload-digest")), "body", "clash"))
    df = spark.createDataFrame(rows, SCHEMA)
    for slices in (1, 7, 64, None):
        got = warc.resolve_revisits(df, slices).collect()
        assert sorted(((r.record_id, r.status, r.response_id, r.payload_digest, sorted(r.headers.items())) for r in got), key=repr) == brute(rows)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_file_round_trip(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: \"q\"\r\n\r\n<p>hi</p>"
    fields = lambda k, n, d: {"warc-type": k, "warc-record-id": f"<urn:uuid:{n}>", "warc-target-uri": "http://e.com/x", "warc-date": d, "warc-payload-digest": "sha1:Z"}
    records = [
        {"fields": {"warc-type": "warcinfo"}, "block": b"software: x\r\n"},
        {"fields": fields("response", 1, "2024-01-01T00:00:00Z"), "block": http},
        {"fields": fields("revisit", 2, "2024-01-02T00:00:00Z"), "block": b"HTTP/1.1 304 Not Modified\r\nETag: W/\"q\"\r\nExpires: soon\r\n\r\n"},
    ]
    for compress in (True, False):
        raw = warc.write_warc(records, compress)
        assert [(r["fields"]["warc-type"], r["block"]) for r in warc.parse_warc(raw)] == [(r["fields"]["warc-type"], r["block"]) for r in records]
        assert len(list(warc.parse_warc(raw[:-40]))) == 2  # a truncated record is left out
    (tmp_path / "a.warc.gz").write_bytes(warc.write_warc(records))
    caps = warc.read_warc(spark, str(tmp_path))
    assert {(r.kind, r.status, bytes(r.body)) for r in caps.collect()} == {("response", 200, b"<p>hi</p>"), ("revisit", 304, b"")}
    (r,) = warc.resolve_revisits(caps).collect()
    assert r.status == "resolved" and r.headers == {"content-type": "text/html", "etag": 'W/"q"', "expires": "soon"}


def test_malformed_records():
    good = warc.write_warc([{"fields": {"warc-type": "response"}, "block": b"one"}], compress=False)
    for length in (b"abc", b"-5", b"", b"1e3", "\u0663".encode()):
        bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\nlost body\r\n\r\n"
        assert [r["block"] for r in warc.parse_warc(good + bad + good)] == [b"one", b"one"]
        zipped = b"".join(gzip.compress(x) for x in (good, bad, good))
        assert [r["block"] for r in warc.parse_warc(zipped)] == [b"one", b"one"]
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    assert [r["block"] for r in warc.parse_warc(no_length + good)] == [b"one"]
    assert [r["block"] for r in warc.parse_warc(gzip.compress(good) + gzip.compress(good)[:-20] )] in ([b"one"], [b"one", b"one"])
    assert list(warc.parse_warc(b"")) == [] and list(warc.parse_warc(b"\x1f\x8bxx")) == [] and list(warc.parse_warc(b"\xff" * 300_000)) == []


def test_captures_come_in_small_batches(spark, tmp_path):
    records = [{"fields": {"warc-type": "response", "warc-record-id": str(i), "warc-date": "no date"}, "block": b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1000} for i in range(50)]
    (tmp_path / "a.warc.gz").write_bytes(warc.write_warc(records))
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path), batch_bytes=3000).collect()
    assert len({r.record_id for r in rows}) == 50 and all(r.ts is None and len(r.body) == 1000 and r.status == 200 for r in rows)


def test_log_of_odd_pages(spark):
    rows = [(1, "http://a.org/x", None, 7), (None, None, "", None), (1, "http://a.org/x", None, 7)]
    log = warc.crawl_log(spark.createDataFrame(rows, "page_id long, url string, html string, status int"))
    assert log.count() == 6
    got = {(r.record_id, r.status) for r in warc.resolve_revisits(log).collect()}
    assert got == {(3, "missing"), (None, "missing")}  # page 1 was fetched in part only
    assert warc.crawl_log(log.sparkSession.createDataFrame([], "page_id long, url string, html string")).count() == 0
