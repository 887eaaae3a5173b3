import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gneiss.llm import substring_dedup
from gneiss.llm.line_dedup import dedup_lines, kept_text, line_bitmaps, with_bitmaps
from gneiss.llm.substring_dedup import deep_nodes, dedup_substrings, heavy_prefixes, prefix_groups

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_lines(rows, min_docs=3):
    owners = defaultdict(set)
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                owners[key(line)].add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in owners.items() if len(v) >= min_docs}
    return ["\n".join(line for line in (t or "").split("\n") if top.get(key(line), i) == i) for i, t, *_ in rows]


def test_lines_match_brute_force(odd, odd_rows, clashing):
    want = sorted(((r[0], new if r[1] is not None else None) for r, new in zip(odd_rows, brute_lines(odd_rows))), key=repr)
    for docs in (odd, clashing, odd.repartition(9)):
        got = dedup_lines(docs)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want


def test_lines_hot_and_spread_over_partitions(spark, odd):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice((f"a line that very many documents share {k}", f"line of its own number {i} {k}" * 2)) for k in range(rng.randint(1, 4))), None, None, None) for i in range(700)]
    df = spark.createDataFrame(rows, odd.schema).repartition(40)
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == sorted((r[0], t) for r, t in zip(rows, brute_lines(rows)))


def test_bitmaps_are_compressed_and_exact(odd):
    got = {r.doc_id: r for r in line_bitmaps(odd).collect()}
    assert set(got) == {10, 11, None}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[10].keep_bitmap), np.uint8), count=got[10].n_lines)
    assert bits.tolist() == [1, 0, 1, 1] and got[10].n_dropped == 1
    assert kept_text(b"a\nb", None) == (2, 0, b"a\nb")
    assert with_bitmaps(odd, line_bitmaps(odd)).count() == odd.count()


def test_lines_empty(empty):
    assert dedup_lines(empty).count() == 0


def brute_substrings(rows, window=13):
    least = {}
    rank = lambda i: (i is None, i or 0)
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, *_ in rows]
    for (i, *_), w in zip(rows, split):
        for k in range(len(w) - window + 1):
            h = tuple(w[k : k + window])
            if h not in least or rank(i) < rank(least[h]):
                least[h] = i
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if rank(least[tuple(w[k : k + window])]) < rank(i):
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_substrings_match_brute_force(odd, odd_rows, clashing):
    want = sorted(((r[0], r[1] if not n else " ".join(w)) for r, (_, n, w) in zip(odd_rows, brute_substrings(odd_rows))), key=repr)
    for docs in (odd, clashing):
        got = dedup_substrings(docs)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want


def test_substrings_random_with_tiny_windows(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    rng = random.Random(3)
    rows = [(rng.randint(0, 60), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))), None, None, None) for _ in range(80)]
    df = spark.createDataFrame(rows, odd.schema)
    got = sorted(((r.doc_id, r.text) for r in dedup_substrings(df, window=5).collect()), key=repr)
    assert got == sorted(((r[0], r[1] if not n else " ".join(w)) for r, (_, n, w) in zip(rows, brute_substrings(rows, 5))), key=repr)


def test_prefixes_split_what_is_frequent():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1000, (4000, 13)).astype(np.uint32)
    codes[:3000, 0] = 7
    codes[:2000, 1] = 8
    heavy = heavy_prefixes(codes, 16)
    assert len(heavy[0]) == 1 and len(heavy[1]) == 1 and not len(heavy[2])
    groups = prefix_groups(codes, heavy, 16)
    assert np.bincount(groups, minlength=16).max() < 700
    same = prefix_groups(np.repeat(codes[:1], 5, 0), heavy, 16)
    assert len(set(same.tolist())) == 1


def test_deep_nodes_are_groups_of_equal_suffixes():
    rows = np.array([[1, 2], [0, 9], [1, 2], [1, 3], [0, 9]], np.uint8)
    order, heads = deep_nodes(rows, np.zeros((5, 1), np.uint8))
    assert [sorted(x.tolist()) for x in np.split(order, heads[1:])] == [[1, 4], [0, 2], [3]]


def repeated_texts(rng, n):
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    return [(i, " ".join(w for _ in range(rng.randint(1, 4)) for w in (rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(9)])), None, None, None) for i in range(n)]


def test_relays_give_the_same_result(spark, odd, monkeypatch):
    rows = repeated_texts(random.Random(9), 150)
    df = spark.createDataFrame(rows, odd.schema)
    want = sorted(((r[0], r[1] if not n else " ".join(w)) for r, (_, n, w) in zip(rows, brute_substrings(rows, 5))), key=repr)
    for name, value in (("BUCKET_BYTES", 900), ("RANGE_BYTES", 400), ("GROUP_SUFFIXES", 10), ("FAN", 5), ("RELAY_ENTRIES", 300)):
        monkeypatch.setattr(substring_dedup, name, value)
    assert sorted(((r.doc_id, r.text) for r in dedup_substrings(df, window=5).collect()), key=repr) == want


def test_blobs_grow_with_the_input_not_with_its_square():
    rng = np.random.default_rng(1)
    fan = substring_dedup.FAN

    def blobs(buckets):
        part = np.sort(rng.integers(0, 3 * buckets, 500_000))  # three ranges for each bucket
        return len(substring_dedup.deal(part, [part.astype(np.uint32)], 3 * buckets, fan))

    assert blobs(300) == 900 and all(blobs(n) <= fan for n in (1_000, 30_000, 1_000_000))


def test_internal_nodes_are_the_maximal_repeats():
    """Nodes of the tree over all suffixes of a text against a count of all its word sequences."""
    rng = random.Random(3)
    for _ in range(20):
        text = [rng.randint(0, 2) for _ in range(40)]
        depth = 6
        codes = np.array([[*text[i : i + depth], *[9 + i] * depth][:depth] for i in range(len(text))], np.uint16)  # ends differ
        raw = np.ascontiguousarray(codes.astype(">u2")).view(np.uint8).reshape(len(codes), -1)
        order = np.lexsort(substring_dedup._as_words(raw)[::-1])
        lcp = substring_dedup.common_prefixes(raw[order])
        got = {(tuple(codes[order[a]][:d].tolist()), b - a) for a, b, d in substring_dedup.internal_nodes(lcp, 2)}
        want = set()
        for d in range(2, depth + 1):  # sequences found twice or more that no one word always follows, or at full depth
            places = {}
            for i in range(len(text)):
                places.setdefault(tuple(codes[i][:d].tolist()), []).append(i)
            for seq, at in places.items():
                if len(at) > 1 and (d == depth or len({int(codes[i][d]) for i in at}) > 1):
                    want.add((seq, len(at)))
        assert got == want
    assert substring_dedup.internal_nodes(np.zeros(0, np.int64), 1) == []


def test_substrings_empty(empty):
    assert dedup_substrings(empty).count() == 0


def test_substring_query_digest(odd, odd_rows, spark, tmp_path):
    odd.where("doc_id IS NOT NULL AND doc_id NOT IN (6, 15)").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (6, 15)]
    want = {r[0]: (n, m, hashlib.sha256(" ".join(w).encode()).hexdigest()) for r, (n, m, w) in zip(rows, brute_substrings(rows))}
    got = substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert F is not None
