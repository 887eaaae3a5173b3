"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, read_table, slices, small_batches
from .components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The anchors are the words of the perfect binary Golay code: every 23-bit word lies within 3 bits of exactly one.
LENGTH, DATA_BITS, RADIUS = 23, 12, 3
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
ROUTE = 1 << DATA_BITS


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> bytes:
    """Big-endian 8 bytes: a bit is 1 if set in over half of the shingles' XXH64 values."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_digest
    begins, stops = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(begins), 65536):
        part = b"".join([digest(joined[s:e], seed) for s, e in zip(begins[i : i + 65536], stops[i : i + 65536])])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(begins)).tobytes()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long); a null or empty text has fingerprint zero."""

    def calc(batches):
        for batch in slices(batches):
            found = b"".join(fingerprint(t, width, seed) for t in batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(calc, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def fold(fp: np.ndarray) -> np.ndarray:
    """64 bits to 23: each bit of the result is the parity of two or three bits, so distances never grow."""
    low = np.uint64((1 << LENGTH) - 1)
    return ((fp & low) ^ (fp >> np.uint64(LENGTH) & low) ^ (fp >> np.uint64(2 * LENGTH))).astype(np.int64)


def _syndrome(word: np.ndarray) -> np.ndarray:
    word = word.copy()
    for bit in range(LENGTH - 1, LENGTH - DATA_BITS - 1, -1):
        word = np.where(word >> bit & 1, word ^ (GENERATOR << (bit - (LENGTH - DATA_BITS))), word)
    return word


@lru_cache(2)
def ball(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, where its error patterns of weight up to RADIUS + threshold start; the patterns; their weights."""
    words = np.array([sum(1 << b for b in bits) for k in range(min(LENGTH, RADIUS + threshold) + 1) for bits in combinations(range(LENGTH), k)], np.int64)
    syndrome = _syndrome(words)
    order = np.lexsort((np.bitwise_count(words.astype(np.uint32)), syndrome))
    words, syndrome = words[order], syndrome[order]
    return np.searchsorted(syndrome, np.arange((1 << (LENGTH - DATA_BITS)) + 1)), words, np.bitwise_count(words.astype(np.uint32))


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor 0..4095, whether it is the fingerprint's own anchor) for every anchor in reach."""
    starts, patterns, weights = ball(threshold)
    word = fold(fp)
    syndrome = _syndrome(word)
    n = starts[syndrome + 1] - starts[syndrome]
    at = np.repeat(np.arange(len(fp)), n)
    entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[syndrome], n)
    return at, (word[at] ^ patterns[entry]) >> (LENGTH - DATA_BITS), weights[entry] <= RADIUS


def close_pairs(own: np.ndarray, others: np.ndarray, threshold: int, chunk: int = 1 << 21):
    """Yield (i, j) index arrays of all pairs within ``threshold`` bits between ``own`` and ``others``.

    Small groups are compared directly. In large ones, pairs meet through a segment on which they agree
    (threshold + 1 segments, of which one at least is untouched), so work follows the real neighbours.
    """
    if len(own) * len(others) <= 1 << 22:
        step = max(1, chunk // max(1, len(others)))
        for a in range(0, len(own), step):
            yield tuple(x + (a if k == 0 else 0) for k, x in enumerate(np.nonzero(np.bitwise_count(own[a : a + step, None] ^ others[None]) <= threshold)))
        return
    parts = threshold + 1
    cuts = [64 * k // parts for k in range(parts + 1)]
    for lo, hi in zip(cuts, cuts[1:]):
        mask = np.uint64((1 << (hi - lo)) - 1)
        key = others >> np.uint64(lo) & mask
        order = np.argsort(key, kind="stable")
        key = key[order]
        want = own >> np.uint64(lo) & mask
        left, right = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        n = right - left
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(np.cumsum(n[a:]), chunk, "right")) + a)
            m = n[a:b]
            i = np.repeat(np.arange(a, b), m)
            j = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(left[a:b], m)]
            near = np.bitwise_count(own[i] ^ others[j]) <= threshold
            yield i[near], j[near]
            a = b


def forest(own: np.ndarray, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``close_pairs`` joins, one less than the nodes of each component at most."""
    nodes = np.unique(np.concatenate((own, others)))
    label = np.arange(len(nodes))
    at_own, at_others = np.searchsorted(nodes, own), np.searchsorted(nodes, others)
    for i, j in close_pairs(own, others, threshold):
        u, v = label[at_own[i]], label[at_others[j]]
        while len(u := u[keep := u != v]):
            v = v[keep]
            lo, hi = np.minimum(u, v), np.maximum(u, v)
            root = np.arange(len(nodes))
            np.minimum.at(root, hi, lo)
            while not np.array_equal(jump := root[root], root):
                root = jump
            label = root[label]
            u, v = root[u], root[v]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def cells(of: np.ndarray, own: np.ndarray, others: np.ndarray, anchor: np.ndarray, mine: bool, step: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each cell that a row takes part in.

    The rows and the copies of an anchor meet in a grid of ``own[anchor]`` by ``others[anchor]`` cells: an own row is
    in one line of it, a copy in one column, by the hash ``of`` it, so each pair meets in one cell and no cell is large.
    """
    lines, columns = (own, others)[not mine][anchor], (own, others)[mine][anchor]  # how many there are of the row's kind, how many it goes to
    first = (of * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % lines
    row = np.repeat(np.arange(len(anchor)), columns)
    every = np.arange(len(row)) - np.repeat(np.cumsum(columns) - columns, columns)
    line, column = (first[row], every) if mine else (every, first[row])
    return row, (anchor[row] * step + line) * step + column


def grid_sizes(rows: DataFrame, anchors_of, count: int, own_rows: int, other_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` anchors, into how many parts its own rows and its copies are cut.

    ``anchors_of(batch)`` yields (anchor, mine) arrays. One row for each anchor comes to the driver.
    """

    def load(batches):
        total = np.zeros((2, count), np.int64)
        for batch in batches:
            for anchor, mine in anchors_of(batch):
                total[0] += np.bincount(anchor[mine], minlength=count)
                total[1] += np.bincount(anchor, minlength=count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(total[0]), pa.array(total[1])], names=["anchor", "own", "others"])

    own, others = np.ones(count, np.int64), np.ones(count, np.int64)
    for r in rows.mapInArrow(load, "anchor long, own long, others long").groupBy("anchor").agg(F.sum("own").alias("own"), F.sum("others").alias("others")).collect():
        own[r.anchor], others[r.anchor] = max(1, -(-r.own // own_rows)), max(1, -(-r.others // other_rows))
    return own, others


def similar_links(fps: DataFrame, threshold: int = 3, group_rows: int = 400_000) -> DataFrame:
    """Links ``u, v`` with the components of all pairs of fingerprints at most ``threshold`` bits apart.

    Anchors cover the folded space with radius 3; each fingerprint goes to every anchor within 3 + threshold
    bits. A pair shares the anchor of either of its ends, where the end's own row meets the other's copy. An
    anchor with more than ``group_rows`` own rows or copies is cut into a grid.
    """

    def anchors_of(batch):
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fp), 4_000):
            yield anchors(fp[a : a + 4_000], threshold)[1:]

    own, others = grid_sizes(fps, anchors_of, ROUTE, group_rows, group_rows)

    def deal(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(whole), 2_000):
                fp = whole[a : a + 2_000]
                at, anchor, mine = anchors(fp, threshold)
                copies, key = cells(fp[at], own, others, anchor, False)
                firsts, own_key = cells(fp[at[mine]], own, others, anchor[mine], True)
                out = np.concatenate((fp[at][copies], fp[at[mine]][firsts])).view(np.int64)
                is_own = np.concatenate((np.zeros(len(key), bool), np.ones(len(own_key), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((key, own_key))), pa.array(out), pa.array(is_own)], names=["key", "fp", "own"])

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        mine = table.column("own").to_numpy()
        u, v = forest(np.unique(fp[mine]), np.unique(fp[~mine]), threshold)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return fps.mapInArrow(deal, "key long, fp long, own boolean").groupBy("key").applyInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, threshold: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint and the component of every row: ``doc_id, fingerprint, component_id``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of ``width`` words.
    Equal fingerprints are one node; nodes at most ``threshold`` bits apart are linked, exactly, by
    anchor-point covering; a component carries the smallest id of its documents. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows are repeated in the result; null ids count
    as larger than all others (a component of null ids only has a null id). Other columns are ignored; an empty
    table gives an empty result.
    """
    marks = materialise(fingerprints(docs, width, seed, id_col, text_col))
    nodes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(materialise(similar_links(nodes.select("fp"), threshold)))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = materialise(named)
    best = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(best, "label").select(F.col("fp").alias("_fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns."""
    found = simhash_components(docs, id_col=id_col, text_col=text_col, **how)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(F.col("_first")), "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; odd rows as in ``simhash_components``."""
    return simhash_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))
