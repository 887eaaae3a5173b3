import math
import os
from collections import Counter

import numpy as np
import pytest

from gneiss.llm import sentencepiece_sample as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file here")


def test_round_trip_and_reproducible(odd, odd_rows, clashing):
    for docs in (odd, clashing):
        enc = sp.encode(docs, MODEL)
        rows = enc.collect()
        assert sorted(((r.doc_id, r.text) for r in sp.decode(enc, MODEL).collect()), key=repr) == sorted(((r[0], r[1]) for r in odd_rows), key=repr)
        again = sp.encode(docs.repartition(5), MODEL).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    other = sp.encode(odd, MODEL, alpha=0.2, seed=1).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, rows))


def segmentations(model, s):
    if not s:
        yield (), 0.0
    for n in range(1, min(16, len(s)) + 1):
        i = model.texts.get(s[:n])
        if i is not None:
            for rest, w in segmentations(model, s[n:]):
                yield (i, *rest), w + model.weights[i]


def test_samples_follow_the_lattice():
    model = sp.pieces(MODEL, 0.5)
    n = 60_000
    offsets, ids = sp.encode_batch(model, ["thinonha"] * n, np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:]))
    every = list(segmentations(model, " thinonha"))
    mass = sum(math.exp(w) for _, w in every)
    assert set(seen) <= {s for s, _ in every}
    for s, w in every:
        p = math.exp(w) / mass
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_long_chunks_take_the_same_law():
    model = sp.pieces(MODEL, 1.0)
    long = "ab" * 5000
    offsets, ids = sp.encode_batch(model, [long, "x" * 63, "x" * 64, "漢" * 3000], np.arange(4))
    for t, a, b in zip([long, "x" * 63, "x" * 64, "漢" * 3000], offsets[:-1], offsets[1:]):
        assert sp.decode_ids(model, ids[a:b].tolist()) == t


@pytest.mark.parametrize("alpha", [0.1, 1.0, 5.0, 8.0])
def test_uncovered_characters_among_words(alpha):
    """Characters of two, three and four bytes without a piece, 1 to 64 of them, next to words; and rare covered ones."""
    model = sp.pieces(MODEL, alpha)
    texts = [f"{c * k} word{c * k}x {c * (65 - k)}" for c in "ʬ㐀😀" for k in (1, 2, 7, 10, 19, 20, 21, 26, 33, 40, 63, 64)]
    texts += ["😀" * 30 + "word", "𒀀" * 30 + " word", "qzxjkwvqz" * 7, "-" * 63, "", " ", "\n", "  \n \n"]
    many = [t for t in texts for _ in range(20)]
    offsets, ids = sp.encode_batch(model, many, np.arange(len(many)))
    raw, ends = model.decode_flat(ids, offsets)
    assert [raw[a:b].decode()[1:] if b > a else "" for a, b in zip(ends[:-1], ends[1:])] == many
    assert sp.decode_ids(model, ids[: offsets[1]].tolist()) == many[0]


def test_law_with_an_uncovered_character():
    model = sp.pieces(MODEL, 1.0)
    n = 40_000
    offsets, ids = sp.encode_batch(model, ["no㐀he"] * n, np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:]))
    raw = tuple(model.fallback[list("㐀".encode())].tolist())
    every = [((*a, *raw, *b), u + v) for a, u in segmentations(model, " no") for b, v in segmentations(model, "he")]
    mass = sum(math.exp(w) for _, w in every)
    assert set(seen) <= {s for s, _ in every}
    for s, w in every:
        p = math.exp(w) / mass
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_models_that_break_the_assumptions_are_refused(monkeypatch):
    import sentencepiece

    class Odd:
        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a\u2581b"
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="spans chunks"):
        sp.PieceBytes("x")
    Odd.id_to_piece = lambda self, i: "ab"
    with pytest.raises(ValueError, match="byte pieces"):
        sp.PieceBytes("x")


def test_query_decodes_to_its_input(spark, clashing, odd_rows, tmp_path):
    import hashlib

    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.n_ids, r.decoded_sha256) for r in sp.op1_sentencepiece(spark, str(tmp_path)).collect()]
    assert sorted(((i, s) for i, _, s in got), key=repr) == sorted(((r[0], None if r[1] is None else hashlib.sha256(r[1].encode()).hexdigest()) for r in odd_rows), key=repr)
    assert all((n is None) == (s is None) for _, n, s in got)


def test_ids_are_known_to_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = sp.pieces(MODEL, 1.0)
    offsets, ids = sp.encode_batch(model, ["Hello  world, naïve\ttext"], np.array([3]))
    assert lib.decode(ids.tolist()) == "Hello  world, naïve\ttext"


def test_empty(empty):
    assert sp.encode(empty, MODEL).count() == 0
