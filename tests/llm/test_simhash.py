import random
import re

import numpy as np
import xxhash

from gneiss.llm import simhash
from gneiss.llm.components import connected_components


def brute_fp(text, width=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    k = min(width, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_code_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    at, anchor, own = simhash.anchors(words.astype(np.uint64), 3)
    assert np.bincount(at[own], minlength=2000).tolist() == [1] * 2000  # one word of the code within 3 bits
    starts, patterns, weights = simhash.ball(3)
    assert len(patterns) == sum(__import__("math").comb(23, k) for k in range(7)) and weights.max() == 6
    assert 0 <= anchor.min() and anchor.max() < 4096


def test_fold_never_grows_distances():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        f = simhash.fold(np.array([a, b], np.uint64))
        assert bin(int(f[0] ^ f[1])).count("1") <= 3


def near_points(rng, clusters, size):
    out = set()
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
    return sorted(out)


def test_links_equal_all_pairs(spark):
    rng = random.Random(4)
    points = near_points(rng, 60, 12) + [rng.getrandbits(64) for _ in range(500)]
    f = np.array(points, np.uint64)
    near = [(points[i], points[j]) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3).tolist() if j != i]
    want = classes(points, near)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    for limit in (400_000, 50):  # the second splits every anchor
        links = simhash.similar_links(df, 3, limit)
        labels = {int(np.int64(r.node).view(np.uint64)): r.label for r in connected_components(links).collect()}
        groups = {}
        for p in points:
            groups.setdefault(labels.get(p, ("alone", p)), set()).add(p)
        wanted = {}
        for p in points:
            wanted.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_large_group_is_indexed():
    rng = np.random.default_rng(1)
    others = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    own = others[:3000] ^ (np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64))
    pairs = {(int(a), int(b)) for i, j in simhash.close_pairs(own, others, 3) for a, b in zip(i, j)}
    assert {(k, k) for k in range(3000)} <= pairs
    assert all(bin(int(own[a] ^ others[b])).count("1") <= 3 for a, b in list(pairs)[:500])


def test_components_match_brute_force(odd, odd_rows, clashing):
    fps = [brute_fp(r[1]) for r in odd_rows]
    want = classes(fps, [(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 3])
    least = {}
    for r, f in zip(odd_rows, fps):
        if r[0] is not None:
            least[want[f]] = min(r[0], least.get(want[f], r[0]))
    expect = sorted(((r[0], f"{f:016x}", least.get(want[f])) for r, f in zip(odd_rows, fps)), key=repr)
    for docs in (odd, clashing):
        got = simhash.simhash_components(docs).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == expect


def test_long_chains_and_stars_contract(spark):
    n = 400
    chain = [(i, i + 1) for i in range(n)]
    star = [(10_000, 10_001 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "u long, v long")
    found = {r.node: r.label for r in connected_components(df).collect()}
    assert len({found[i] for i in range(n + 1)}) == 1 and len({found[x] for e in star for x in e}) == 1 and len(set(found.values())) == 2


def test_empty(empty, spark):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_keep_first_keeps_columns(clashing, odd_rows):
    got = simhash.keep_first(clashing)
    assert got.columns == clashing.columns
    ids = [r.doc_id for r in got.collect()]
    assert 5 in ids and 6 not in ids and 1 in ids and 2 not in ids  # copies of 5; nulls and blanks share fingerprint zero


def test_cut_anchors_give_the_same_links(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) for c in centres] + [rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3}

    def groups(links):
        label = {int(x): int(x) for x in fps}
        root = lambda x: x if label[x] == x else root(label[x])
        for u, v in links:
            label[root(u)] = root(v)
        out = {}
        for x in label:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    for group_rows in (3, 400_000):
        got = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.similar_links(df, 3, group_rows).collect()]
        assert groups(got) == groups(want)
