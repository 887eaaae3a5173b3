import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from gneiss.llm.packing import optimal_boundaries, pack


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist)


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(150):
        m = rng.randint(1, 9)
        hist = [(x, rng.randint(1, 50)) for x in rng.sample(range(1, 40), m)]
        k = rng.randint(1, 5)
        got = optimal_boundaries(hist, k)
        top = max(x for x, _ in hist)
        best = min(padding(hist, [*c, top]) for r in range(0, min(k, m)) for c in itertools.combinations([x for x, _ in hist if x != top], r))
        assert len(got) <= k and got == sorted(set(got)) and padding(hist, got) == best
    assert optimal_boundaries([], 3) == []


def check(docs, want_rows, **how):
    got = pack(docs, **how).collect()
    budget = how.get("batch_tokens", 16_384)
    by_batch, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert 1 <= r.n_tokens <= r.padded
        by_batch[r.bucket, r.batch].append(r)
        by_doc[r.doc_id].append(r)
    for (bucket, _), own in by_batch.items():
        assert len({r.padded for r in own}) == 1
        assert len(own) == 1 or len(own) * own[0].padded <= budget
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for bucket in {b for b, _ in by_batch}:
        numbers = sorted(n for b, n in by_batch if b == bucket)
        assert numbers == list(range(len(numbers)))
        full = [len(by_batch[bucket, n]) for n in numbers]
        assert all(x == full[0] for x in full[:-1]) and full[-1] <= full[0]
    assert len(got) == want_rows
    return by_doc


def test_every_piece_is_packed(odd, odd_rows, clashing):
    sizes = {r.doc_id: r.s for r in odd.where("doc_id NOT IN (6, 15)").select("doc_id", F.expr("coalesce(regexp_count(text, '[\\\\p{L}\\\\p{N}_]+|[^\\\\p{L}\\\\p{N}_\\\\x20\\\\x09-\\\\x0D]'), 0) + 1").alias("s")).collect()}
    for docs in (odd, clashing):
        total = pack(docs, max_tokens=100, batch_tokens=400).count()
        by_doc = check(docs, total, max_tokens=100, batch_tokens=400, buckets=4)
        for i, s in sizes.items():
            assert sum(r.n_tokens for r in by_doc[i]) == s
            assert sorted(r.piece for r in by_doc[i]) == list(range(-(-s // 100)))
        assert set(by_doc) == {r[0] for r in odd_rows}


def test_own_length_column(odd):
    check(odd, odd.count(), length=F.col("n_chars"), buckets=3, batch_tokens=64)


def test_empty(empty):
    assert pack(empty).count() == 0
