import itertools
import random
import re
from collections import Counter

import numpy as np

from gneiss.llm import quality
from gneiss.llm.crf import Chain, fit


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = Chain(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([3, 0, 5, 1, 4])
    x = rng.normal(size=(lengths.sum(), 4))
    got = chain.viterbi(x, lengths)
    at = 0
    for n in lengths:
        s = x[at : at + n] @ chain.emit
        if n:
            best = max(itertools.product(range(3), repeat=n), key=lambda p: chain.start[p[0]] + sum(s[i, p[i]] for i in range(n)) + sum(chain.move[a, b] for a, b in zip(p, p[1:])))
            assert tuple(got[at : at + n]) == best
        at += n


def test_fit_learns_a_chain():
    rng = np.random.default_rng(1)
    seqs = []
    for _ in range(200):
        y = np.cumsum(rng.random(12) < 0.2) % 2
        seqs.append((np.stack([np.ones(12), y + rng.normal(0, 0.7, 12)], 1), y))
    chain = fit(seqs[:150])
    test = seqs[150:]
    x, y = np.concatenate([a for a, _ in test]), np.concatenate([b for _, b in test])
    got = chain.viterbi(x, np.array([len(b) for _, b in test]))
    alone = x[:, 1] > 0.5  # the best rule that looks at one place only
    assert (got == y).mean() > (alone == y).mean() + 0.02


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cov = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_counts_match_brute_force(odd, odd_rows, clashing):
    rng = random.Random(0)
    texts = [r[1] for r in odd_rows] + [" ".join(rng.choice("ab|é") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    assert [quality.base_counts(t.encode() if t is not None else None) for t in texts] == [brute(t) for t in texts]
    for docs in (odd, clashing):
        got = quality.quality_rules(docs, None).collect()
        want = [(r[0], *brute(r[1])) for r in odd_rows]
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed)  # without labels every line is content


def test_trained_chain_tells_junk_from_prose(spark):
    rng = random.Random(3)
    prose = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20)) + "." for _ in range(6))
    junk = lambda: "\n".join(" | ".join("".join(rng.choice("ABCD") for _ in range(5)) + "$$$" for _ in range(9)) for _ in range(6))
    rows = [(i, prose() if i % 2 else junk()) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    chain = quality.train(docs, labels)
    kept = {r.doc_id for r in quality.quality_rules(docs, chain).where("kept").collect()}
    assert kept == {i for i in range(120) if i % 2}
    assert {r.doc_id for r in quality.keep_good(docs, chain).collect()} == kept
    assert quality.train(docs, labels.limit(0)) is None


def lines_of(rng, kind, n):
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 8)))
    make = {
        "prose": lambda: " ".join(word() for _ in range(rng.randint(6, 25))).capitalize() + ".",
        "menu": lambda: " | ".join(word() for _ in range(rng.randint(3, 12))),
        "shout": lambda: " ".join(word().upper() + "!!" for _ in range(rng.randint(3, 12))),
    }
    return [make[kind]().encode() for _ in range(n)]


def test_held_out_lines_and_documents():
    """The chain labels lines: in documents of both kinds of lines, which no training document is, it finds the borders."""
    rng = random.Random(8)
    labelled = [(lines_of(rng, "prose", rng.randint(1, 9)), True) for _ in range(120)] + [(lines_of(rng, rng.choice(["menu", "shout"]), rng.randint(1, 9)), False) for _ in range(60)]
    chain = quality.learn(labelled)
    right = total = 0
    shares = []
    for _ in range(200):
        parts = [(k, rng.randint(1, 6)) for k in rng.sample(["prose", rng.choice(["menu", "shout"])], 2)]
        lines = [x for k, n in parts for x in lines_of(rng, k, n)]
        truth = np.array([k == "prose" for k, n in parts for _ in range(n)])
        got = chain.viterbi(quality.line_features(lines), np.array([len(lines)]))
        right += int((got == truth).sum())
        total += len(lines)
        shares.append(float(quality.content_shares([b"\n".join(lines)], chain)[0]))
    assert right / total >= 0.9
    assert sum(0.05 < s < 0.95 for s in shares) > 150  # shares are not just none or all
    alone = [lines_of(rng, k, 6) for k in ("menu", "shout") * 50]
    assert (quality.content_shares([b"\n".join(x) for x in alone], chain) < 0.5).mean() >= 0.9
    fine = [lines_of(rng, "prose", 6) for _ in range(100)]
    assert (quality.content_shares([b"\n".join(x) for x in fine], chain) >= 0.5).mean() >= 0.97
    assert quality.learn(labelled[:120]) is None and quality.learn([]) is None


def brute_best(chain, x):
    paths = itertools.product(range(2), repeat=len(x))
    s = x @ chain.emit
    return max(paths, key=lambda p: chain.start[p[0]] + sum(s[i, p[i]] for i in range(len(x))) + sum(chain.move[a, b] for a, b in zip(p, p[1:])))


def test_verdicts_match_brute_force(spark):
    """``content_share`` and ``kept`` against an enumeration of all labellings."""
    rng = random.Random(4)
    chain = quality.learn([(lines_of(rng, "prose", 5), True) for _ in range(30)] + [(lines_of(rng, "menu", 5), False) for _ in range(30)])
    texts = [b"\n".join(x for _ in range(rng.randint(0, 3)) for x in lines_of(rng, rng.choice(["prose", "menu", "shout"]), rng.randint(1, 3))).decode() for _ in range(80)] + [None, "", "\n\n", "x"]
    got = {r.doc_id: (r.content_share, r.kept) for r in quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").encode().split(b"\n")
        path = brute_best(chain, quality.line_features(lines))
        sizes = [len(re.sub(rb"[\x20\x09-\x0d]", b"", x)) for x in lines]
        share = sum(s for s, m in zip(sizes, path) if m) / sum(sizes) if sum(sizes) else 0
        n, _, _, _, rep = brute(t)
        assert abs(got[i][0] - share) < 1e-12
        assert got[i][1] == (n >= 10 and 100 * rep <= 20 * n and share >= 0.5)


def test_empty(empty):
    assert quality.quality_rules(empty, None).count() == 0
    assert quality.keep_good(empty, None).count() == 0
