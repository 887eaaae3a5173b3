"""Quality rules: counts over whole texts, then a line-labelling chain decides whether a text is mostly content."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, slices, small_batches
from .crf import Chain, fit

CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?~=+_^@{}[]\\/"
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xc2\xbb", b"\xe2\x80\x9d", b"\xe3\x80\x82")
WIDTH = 14


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of features for each line: lengths, shares of character kinds, repetition, ending."""
    rows, seen = [], set()
    for line in lines:
        size = len(line)
        words = line.split()
        n = len(words)
        solid = size - (len(line) - len(line.translate(None, BLANKS))) or 1
        upper = (size - len(line.translate(None, UPPER))) / solid
        symbols = (size - len(line.translate(None, SYMBOLS))) / solid
        digits = (size - len(line.translate(None, DIGITS))) / solid
        marks = (size - len(line.translate(None, MARKS))) / solid
        bare = line.strip(BLANKS)
        again = n > 0 and line in seen
        seen.add(line)
        rows.append((1.0, min(np.log1p(solid), 8.0) / 8.0, float(n == 0), float(0 < n <= 2), min(solid / max(n, 1), 20.0) / 20.0, upper, float(upper > 0.5), symbols * 4, float(symbols > 0.08), digits, marks * 4, float(again), float(n > 7 and 4 * len(set(words)) < n), float(bare.endswith(ENDS))))
    return np.array(rows, np.float64).reshape(-1, WIDTH)


def base_counts(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    if not raw:
        return 0, 0, 0, 0, 0
    words = raw.split()  # bytes.split() cuts at ASCII white space only
    solid = raw.translate(None, BLANKS)
    chars = len(solid.translate(None, CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line.strip(BLANKS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total, end = 0, 0  # words before ``end`` are counted already
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def mixed_sequences(good: list[list[bytes]], bad: list[list[bytes]], seed: int = 11) -> list[tuple[list[bytes], np.ndarray]]:
    """Line sequences whose labels change: a block of lines of one kind of document set into one of the other kind.

    Every document gives one sequence; the block, its length and its place are drawn with ``seed``.
    """
    rng = random.Random(seed)
    out = []
    for hosts, guests, label in ((good, bad, 1), (bad, good, 0)):
        for lines in hosts:
            guest = rng.choice(guests)
            size = rng.randint(1, max(1, min(len(guest), len(lines))))
            begin = rng.randint(0, len(guest) - size)
            place = rng.randint(0, len(lines))
            marks = np.full(len(lines) + size, label)
            marks[place : place + size] = 1 - label
            out.append((lines[:place] + guest[begin : begin + size] + lines[place:], marks))
    return out


def learn(labelled: list[tuple[list[bytes], bool]]) -> Chain | None:
    """Fit the chain on documents given as (lines, good).

    Labels are those of documents, but the chain is to label lines. Each document is seen alone and mixed with lines
    of one of the other kind, so that labels change inside sequences. In a second round, lines of bad documents that
    the first chain takes for content in spite of their label count as content. None unless both kinds are there.
    """
    good, bad = [x for x, ok in labelled if ok and x], [x for x, ok in labelled if not ok and x]
    if not good or not bad:
        return None
    mixed = [(line_features(x), y) for x, y in mixed_sequences(good, bad)]
    own = [(line_features(x), np.ones(len(x), np.int64)) for x in good]
    doubtful = [(line_features(x), np.zeros(len(x), np.int64)) for x in bad]
    chain = fit(mixed + own + doubtful, settled=1e-3)
    found = chain.viterbi(np.concatenate([x for x, _ in doubtful]), np.array([len(x) for x, _ in doubtful]))
    cuts = np.cumsum([len(x) for x, _ in doubtful])[:-1]
    return fit(mixed + own + [(x, y.astype(np.int64)) for (x, _), y in zip(doubtful, np.split(found, cuts))])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_lines: int = 64, max_chars: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """Fit the line chain on a bounded sample of labelled documents.

    At most ``max_docs`` labelled documents (the first by hash of their id), the first ``max_lines`` lines of each and
    the first ``max_chars`` characters of a line are used, for fitting only; ``learn`` tells how. Documents with a
    null id, text or quality are left out; of repeated rows ``2 * max_docs`` are used at most. None where usable labels
    of one kind are missing.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    head = F.slice(F.split(F.col(text_col), "\n"), 1, max_lines)
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.transform(head, lambda s: F.substring(s, 1, max_chars)).alias("lines")).join(F.broadcast(chosen), "doc_id")
    rows = pairs.select("doc_id", "quality", "lines").limit(2 * max_docs).collect()
    rows = sorted((r for r in rows if r.lines), key=lambda r: (r.doc_id, r.quality, r.lines))
    return learn([([s.encode() for s in r.lines], r.quality > 0) for r in rows])


def quality_rules(docs: DataFrame, chain: Chain | None, min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules and the chain's verdict for every row.

    Viterbi decoding labels each line of the whole text as content or boilerplate; a text is kept if its content
    lines hold at least ``min_content`` of the characters of all lines. ``chain`` None (no labels to learn from)
    takes every line as content.

    Results: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share,
    kept``, one row for each input row, repeated rows included. A null or empty text has no words and fails the
    base rules; its share is 0. Null ids are passed on. Other columns are ignored.
    """

    def label(batches):
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = [base_counts(t) for t in texts]
            shares = content_shares(texts, chain)
            n, chars, symbols, dup, rep = (np.array(c, np.int64) for c in zip(*counts)) if counts else [np.zeros(0, np.int64)] * 5
            failed = (n < min_words) | (100 * rep > max_repeat_percent * n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in (n, chars, symbols, dup, rep)), pa.array(failed), pa.array(shares), pa.array(~failed & (shares >= min_content))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(label, schema)


def keep_good(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; decided row by row, nothing is moved."""
    schema = docs.schema
    at = schema.names.index(text_col)
    least, most, share = rules.get("min_words", 10), rules.get("max_repeat_percent", 20), rules.get("min_content", 0.5)

    def choose(batches):
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            counts = [base_counts(t) for t in texts]
            good = content_shares(texts, chain) >= share
            good &= np.array([c[0] >= least and 100 * c[4] <= most * c[0] for c in counts], bool)
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(choose, schema)


def content_shares(texts: list[bytes | None], chain: Chain | None) -> np.ndarray:
    """The share of characters in lines that the chain marks as content, for each text."""
    shares = np.zeros(len(texts))
    for begin in range(0, len(texts), 512):
        split = [(t or b"").split(b"\n") for t in texts[begin : begin + 512]]
        lengths = np.array([len(s) for s in split], np.int64)
        sizes = np.array([len(line.translate(None, BLANKS)) for s in split for line in s], np.float64)
        marks = chain.viterbi(np.concatenate([line_features(s) for s in split]), lengths) if chain else np.ones(len(sizes))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        whole = np.add.reduceat(sizes, starts)
        good = np.add.reduceat(sizes * marks, starts)
        shares[begin : begin + len(split)] = np.where(whole > 0, good / np.maximum(whole, 1), 0)
    return shares


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the chain's verdict of every document; odd rows as in ``quality_rules``."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules(docs, train(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality")))
