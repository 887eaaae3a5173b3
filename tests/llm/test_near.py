import random

import numpy as np
from test_simhash import classes

from gneiss.llm import near

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows, least=0.8):
    """The smallest id of the group of each row that has an id, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    alike = lambda a, b: a == b or bool(a and b) and len(a & b) >= least * len(a | b) - 1e-9
    label = classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[label[i]] = min(r[0], first.get(label[i], r[0]))
    return {r[0]: first[label[i]] for i, r in enumerate(rows) if r[0] is not None}


def near_rows(rng, groups=12, copies=8):
    rows, n = [], 100
    for _ in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
            rows.append((n, " ".join(w), "en", "s", 1))
            n += 1
    return rows


def test_groups_match_brute_force(spark, odd, odd_rows, clashing):
    rows = [r for r in odd_rows if r[0] not in (6, 15)]
    want = brute_groups(rows)
    for docs in (odd, clashing):
        got = near.near_groups(docs.where("doc_id IS NULL OR doc_id NOT IN (6, 15)")).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


def test_near_copies_are_found(spark, odd):
    rows = near_rows(random.Random(8))
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(rows, odd.schema).repartition(20)).collect()}
    want = brute_groups(rows)
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)  # the threshold may miss a few
    assert all(want[a] == want[b] for a in got for b in [got[a]])  # and nothing else is linked


def edited(rng, kind, n):
    """A text and a copy with one edit that leaves 0.80 to 0.85 of their five-word shingles."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    other = lambda k: [f"v{rng.randint(0, 10**6)}" for _ in range(k)]
    at = rng.randrange(5, n // 2)
    k = n // 11  # shared (n - k) of (n + k)
    copy = {"block": base[:at] + other(k - 4) + base[at + k - 4 :], "append": base + other(n // 5), "truncate": base[: n - n // 6]}[kind]
    return " ".join(base), " ".join(copy)


def test_block_append_and_truncate_edits_are_all_found(spark, odd):
    rng = random.Random(11)
    rows = []
    for kind in ("block", "append", "truncate"):
        for _ in range(40):
            texts = edited(rng, kind, rng.randint(120, 400))
            a, b = map(shingles, texts)
            assert 0.8 <= len(a & b) / len(a | b) <= 0.85, kind
            rows += [(len(rows) + k, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(rows, odd.schema).repartition(20)).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(rows))}


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, 1 << near.BUCKET_BITS).astype(np.int32)
    alike = 0
    for _ in range(300):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 200))))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.75, 1)], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, len(a) // 8 + 1))))))
        both = len(np.intersect1d(a, b))
        if both and both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
            alike += 1
            assert len(np.intersect1d(near.prefix(a, counts, 0.8), near.prefix(b, counts, 0.8)))
    assert alike > 50


def test_one_large_group_is_not_compared_pair_by_pair(spark, odd, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), None, None, None))
    seen = []
    real = near.candidate_links
    monkeypatch.setattr(near, "candidate_links", lambda *a: seen.append(real(*a)) or seen[-1])
    got = near.near_groups(spark.createDataFrame(rows, odd.schema)).collect()
    assert {r.component_id for r in got} == {0}
    assert seen[0].count() <= len(rows) and sum(x.count() for x in seen) < 0.1 * len(rows) * (len(rows) - 1) / 2


def test_frequent_shingles_are_searched_in_parts(spark, odd, monkeypatch):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        for w in (own, own[:55], own[:40]):
            rows.append((len(rows), " ".join(common + w), None, None, None))
    want = brute_groups(rows)
    assert len(set(want.values())) > 10
    monkeypatch.setattr(near, "NEAREST", ())  # all links have to come from shared shingles
    monkeypatch.setattr(near, "shingle_counts", lambda *a: np.zeros(1 << near.BUCKET_BITS, np.int32))  # frequent ones in the prefixes
    sizes = []
    real = near.prefix_links
    monkeypatch.setattr(near, "prefix_links", lambda members, *a: sizes.append(members.agg({"parts": "max"}).first()[0]) or real(members, *a))
    docs = spark.createDataFrame(rows, odd.schema)
    for part_rows in (7, 100_000):
        assert {r.doc_id: r.component_id for r in near.near_groups(docs, part_rows=part_rows).collect()} == want
    assert max(sizes) >= len(rows) // 7 and min(sizes) == 1


def test_blocks_cover_the_threshold():
    rng = random.Random(5)
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 8):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        at, anchor, mine = near.block_anchors(pair, 8 // 3)
        own = set(anchor[mine & (at == 0)].tolist())
        assert len(own) == 3 and own & set(anchor[at == 1].tolist())


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    ruled = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.uniform(0.5, 1)], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, n // 4 + 2))))))
        rows = [np.frombuffer(near.sketch(x), np.uint8).reshape(1, -1) for x in (a, b)]
        fits = bool(near.may_be_similar(*rows, 0.8)[0])
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert fits
        ruled += not fits
    assert ruled > 50


def test_nothing(empty):
    assert near.near_groups(empty).count() == 0 and near.keep_first(empty).count() == 0
