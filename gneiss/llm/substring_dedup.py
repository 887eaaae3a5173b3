"""Substring dedup by prefix-partitioned suffix trees over words.

Three passes over the texts, which are dealt to buckets of a bounded size by a hash, so that (bucket, word) is an
address that every pass can recompute:

1. Filter: a window can only repeat if its hash is seen in two documents. Buckets send sorted, compressed
   hashes; hash ranges answer with the addresses of windows that another bucket has as well.
2. Trees: of equal windows of a bucket only the smallest document's are suffixes that matter outside. They go,
   as word codes, to the group of their prefix: the shortest prefix that is not too frequent. Each group sorts
   its suffixes into a subtree, cut at the window's depth; its internal nodes at that depth are the repeats. A node's
   smallest document keeps its words, the addresses of all others go back. Repeats that begin one word after
   another in a document are one longer repeat, so the covered stretches of a document are its maximal repeats.
3. Removal: each bucket removes the words covered by windows that repeat in it or were sent back.

Hash ranges and prefix groups are sized by what they hold. Where there are more than FAN of them, buckets send to
coarse ranges first, and relays deal what many buckets sent to the fine ones; so the number of blobs grows with the
input, not with buckets times ranges.

Every window of an equal text with a larger id repeats, so such copies are settled by a digest of the text and
take part in no pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, read_table, shuffle_partitions, slices, small_batches

WINDOW = 13
CODE_BYTES = 2
CHECK_BYTES = 8
#: Text in a bucket, text behind a hash range, suffixes in a prefix group: each is the work of one task at a time.
BUCKET_BYTES, RANGE_BYTES, GROUP_SUFFIXES = 8_000_000, 12_000_000, 1_000_000
#: Ranges that a bucket sends to directly, and entries that a relay holds before it passes them on.
FAN, RELAY_ENTRIES = 2048, 4_000_000
NO_ID = np.iinfo(np.int64).max
_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ``raw``, and how many words each of the texts has that end at ``ends``.

    A byte counts by its place in the word; long words are hashed in stretches of 256 bytes that are chained.
    """
    data = np.frombuffer(raw, np.uint8)
    solid = _SOLID[data]
    begins = np.flatnonzero(solid & ~np.concatenate((np.zeros(min(1, len(solid)), bool), solid[:-1])))
    counts = np.diff(np.searchsorted(begins, ends), prepend=0)
    if not len(begins):
        return np.zeros(0, np.uint64), counts
    bytes_of = data[solid]
    stops = np.flatnonzero(solid & ~np.concatenate((solid[1:], np.zeros(1, bool)))) + 1
    length = stops - begins
    first = np.cumsum(length) - length
    place = np.arange(len(bytes_of), dtype=np.int64) - np.repeat(first, length)
    value = _LETTER[bytes_of] * _PLACE[place & 255]
    value ^= value >> np.uint64(29)
    if length.max() > 256:
        value += place.astype(np.uint64) >> np.uint64(8)
        value *= np.uint64(2) * (place.astype(np.uint64) >> np.uint64(8)) + np.uint64(1)
    return _mix(np.add.reduceat(value, first) + length.astype(np.uint64)), counts


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The hash of each run of ``window`` word hashes, from sums of a polynomial whose base is odd."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(words), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(words * powers)))
    return _mix((sums[window:] - sums[:n]) * back)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """The arrays of ``_pack``: of each, its type and how many make up one entry."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = [np.dtype(t).itemsize * k for t, k in kinds]
    n, at, out = len(raw) // sum(width), 0, []
    for (t, k), w in zip(kinds, width):
        own = np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t)
        out.append(own.reshape(n, k) if k > 1 else own.reshape(n))
        at += n * w
    return out


class Bucket:
    """The documents of a bucket in a fixed order, without copies: the hash of each word, and where windows fit.

    ``facts`` lists the copies of the bucket among its rows, as pairs of id and mark.
    """

    def __init__(self, table: pa.Table, facts: pa.Table, window: int):
        keys, marks = table.column("_key").to_numpy(), table.column("_mark").to_numpy()
        self.window = window
        self.order = np.lexsort((marks, keys))
        self.ids = keys[self.order]
        self.texts = table.column("_text").cast(pa.binary()).take(pa.array(self.order)).to_pylist()
        known = facts.column("copy_ids").combine_chunks().flatten().to_pylist(), facts.column("copy_marks").combine_chunks().flatten().to_pylist()
        copies = set(zip(*known))
        self.copy = np.array([pair in copies for pair in zip(self.ids.tolist(), marks[self.order].tolist())], bool) if copies else np.zeros(len(self.ids), bool)
        own = [b"" if c or t is None else t for t, c in zip(self.texts, self.copy.tolist())]
        self.words, self.counts = hash_words(b" ".join(own), np.cumsum([len(t) + 1 for t in own], dtype=np.int64))
        self.firsts = np.cumsum(self.counts) - self.counts

    def sort_windows(self) -> None:
        """Sort the windows that fit by hash; of each group of equal ones, its start, smallest and largest document."""
        value = window_hashes(self.words, self.window)
        n = len(value)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)[:n]
        self.at = np.flatnonzero(np.arange(n) + self.window <= (self.firsts + self.counts)[owner])  # where windows start
        self.value = value[self.at]
        self.doc = self.ids[owner[self.at]]
        self.sorted = np.argsort(self.value)
        v = self.value[self.sorted]
        self.heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
        d = self.doc[self.sorted]
        self.least = np.minimum.reduceat(d, self.heads) if len(v) else d
        self.most = np.maximum.reduceat(d, self.heads) if len(v) else d
        self.group = np.repeat(np.arange(len(self.heads)), np.diff(self.heads, append=len(v)))  # by sorted place

    def repeated_here(self) -> np.ndarray:
        """Starts of windows that a smaller document of the bucket has as well, checked word by word."""
        later = np.flatnonzero(self.doc[self.sorted] > self.least[self.group])
        own, lead = self.at[self.sorted[later]], self.at[self.sorted[self.heads[self.group[later]]]]
        same = np.ones(len(later), bool)
        for k in range(self.window):
            same &= self.words[own + k] == self.words[lead + k]
        return own[same]


def _cuts(part: np.ndarray, parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of each part in a sorted array of parts."""
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
    return list(zip(parts[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(part)]))


def deal(part: np.ndarray, columns: list[np.ndarray], parts: int, fan: int) -> list[tuple[int, bytes]]:
    """Rows for ``exchange`` from entries that are sorted by part: one blob per part, or per coarse range of parts."""
    if parts <= fan:
        return [(p, _pack(*(c[lo:hi] for c in columns))) for p, lo, hi in _cuts(part, part)]
    coarse = part // -(-parts // fan)
    return [(p, _pack(part[lo:hi].astype(np.uint32), *(c[lo:hi] for c in columns))) for p, lo, hi in _cuts(coarse, coarse)]


def exchange(sent: DataFrame, parts: int, kinds: tuple[tuple[type, int], ...], fan: int) -> DataFrame:
    """``part, sent`` as ``deal`` made them, with one part for each range; in between, relays where there are many."""
    if parts <= fan:
        return sent
    most = RELAY_ENTRIES

    def relay(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            part, *columns = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(part, kind="stable")
            part = part[order]
            rows = [(p, _pack(*(c[order[lo:hi]] for c in columns))) for p, lo, hi in _cuts(part, part)]
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows[a : a + 1000]], pa.int32()), pa.array([b for _, b in rows[a : a + 1000]], pa.binary())], names=["part", "sent"])

        for batch in batches:
            for blob in batch.column(1).to_pylist():
                held.append(_unpack(blob, (np.uint32, 1), *kinds))
                size += len(held[-1][0])
                if size >= most:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return sent.repartition("part").mapInArrow(relay, "part int, sent binary")


FACTS = "_bucket int, places binary, copy_ids array<long>, copy_marks array<long>"


def _bucketed(docs: DataFrame, buckets: int, id_col: str, text_col: str, *more: str) -> DataFrame:
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    own = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), mark.alias("_mark"), F.col(text_col).cast("string").alias("_text"), *more)
    return own.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_mark"), F.lit(buckets)).cast("int"))


def equal_texts(bucketed: DataFrame, salts: int = 64) -> DataFrame:
    """For each bucket its rows whose text is that of a smaller id, in the form of FACTS.

    Digests are compared in two levels, within salts and over them, and the answer goes back the same way, so a
    text that a third of all rows share is spread over the salts.
    """
    rows = bucketed.where(F.octet_length("_text") > 0).select("_bucket", "_key", "_mark", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    parts = rows.groupBy("_salt", "_sha").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    whole = parts.groupBy("_sha").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most")).where("_least < _most").select("_sha", "_least")
    answer = parts.select("_salt", "_sha").join(whole, "_sha")
    copies = rows.join(answer, ["_salt", "_sha"]).where("_key > _least")
    found = copies.groupBy("_bucket").agg(F.collect_list("_key").alias("copy_ids"), F.collect_list("_mark").alias("copy_marks"))
    return found.select("_bucket", F.lit(None).cast("binary").alias("places"), "copy_ids", "copy_marks")


def repeat_candidates(bucketed: DataFrame, copies: DataFrame, parts: int, window: int) -> DataFrame:
    """Pass 1: ``_bucket, places, n``, the starts of windows whose hash another bucket has too, and how many."""
    fan = FAN
    keep = np.uint64(max(16, (parts - 1).bit_length()))  # bits dropped, so that the products below fit into 64
    kinds = ((np.uint32, 1), (np.uint32, 1), (np.uint32, 1))

    def send(table: pa.Table, facts: pa.Table) -> pa.Table:
        b = Bucket(table, facts, window)
        b.sort_windows()
        bucket = table.column("_bucket")[0].as_py() if table.num_rows else 0
        single = (b.least == b.most)[b.group]
        first = np.zeros(len(b.sorted), bool)
        first[b.heads] = True
        chosen = b.sorted[single | first]
        value, at = b.value[chosen], b.at[chosen].astype(np.uint32)
        scaled = (value >> keep) * np.uint64(parts)  # sorted like value
        part = (scaled >> (np.uint64(64) - keep)).astype(np.int64)
        key = (scaled >> (np.uint64(32) - keep) if keep < 32 else scaled).astype(np.uint32)
        rows = deal(part, [key, at, np.full(len(at), bucket, np.uint32)], parts, fan)
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "sent": pa.array([s for _, s in rows], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        keys, places, owners = [], [], []
        for blob in table.column("sent").to_pylist():
            key, at, owner = _unpack(blob, *kinds)
            keys.append(key)
            places.append(at)
            owners.append(owner)
        key, place, owner = np.concatenate(keys), np.concatenate(places), np.concatenate(owners)
        order = np.argsort(key)
        key, owner_sorted = key[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        several = np.minimum.reduceat(owner_sorted, heads) != np.maximum.reduceat(owner_sorted, heads)
        hit = order[np.repeat(several, np.diff(heads, append=len(key)))]
        rows = _by_owner(owner[hit], place[hit])
        return pa.table({"_bucket": pa.array([o for o, _, _ in rows], pa.int32()), "places": pa.array([p for _, p, _ in rows], pa.binary()), "n": pa.array([n for _, _, n in rows], pa.int64())})

    sent = bucketed.groupBy("_bucket").cogroup(copies.groupBy("_bucket")).applyInArrow(send, "part int, sent binary")
    return exchange(sent, parts, kinds, fan).groupBy("part").applyInArrow(meet, "_bucket int, places binary, n long")


def _by_owner(owner: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes, int]]:
    """(owner, its places packed, how many) of each owner."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order].astype(np.uint32)
    return [(o, _pack(np.diff(place[lo:hi], prepend=np.uint32(0))), hi - lo) for o, lo, hi in _cuts(owner, owner)]


def _places(table: pa.Table) -> np.ndarray:
    found = [np.cumsum(_unpack(blob, (np.uint32, 1))[0], dtype=np.uint32) for blob in table.column("places").to_pylist() if blob is not None]
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def heavy_prefixes(codes: np.ndarray, groups: int) -> list[np.ndarray]:
    """Of a sample of suffixes (rows of word codes), for each depth the hashes of prefixes that are too frequent."""
    out, limit = [], max(2, len(codes) // (4 * max(1, groups)))
    value, held = np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for d in range(codes.shape[1] - 1):
        value[held] = _extend(value[held], codes[held, d])
        found, n = np.unique(value[held], return_counts=True)
        out.append(found[n > limit])
        held = held[np.isin(value[held], out[-1])]
    return out


def _extend(value: np.ndarray, code: np.ndarray) -> np.ndarray:
    x = (value ^ (code.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def prefix_groups(codes: np.ndarray, heavy: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of each suffix: a hash of its shortest prefix that is not too frequent (all of it, if none is)."""
    value, held = np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for d in range(codes.shape[1]):
        value[held] = _extend(value[held], codes[held, d])
        if d >= len(heavy) or not len(heavy[d]):
            break
        held = held[np.isin(value[held], heavy[d])]
    return (((value >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _codes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return (words[at[:, None] + np.arange(window)] >> np.uint64(64 - 8 * CODE_BYTES)).astype(np.uint32)


def common_prefixes(ranked: np.ndarray) -> np.ndarray:
    """How many words each of the sorted suffixes shares with the one before it (the first: none)."""
    n, width = ranked.shape
    apart = (ranked[1:] != ranked[:-1]).reshape(max(0, n - 1), width // CODE_BYTES, CODE_BYTES).any(2)
    return np.concatenate((np.zeros(min(1, n), np.int64), np.where(apart.any(1), apart.argmax(1), width // CODE_BYTES)))


def internal_nodes(lcp: np.ndarray, least_depth: int) -> list[tuple[int, int, int]]:
    """(begin, end, depth) of every internal node of the tree over sorted suffixes, of ``least_depth`` words or more."""
    out, open_nodes = [], []
    for i, depth in enumerate([*lcp.tolist()[1:], 0], 1):
        begin = i - 1
        while open_nodes and open_nodes[-1][1] > depth:
            begin, own = open_nodes.pop()
            if own >= least_depth:
                out.append((begin, i, own))
        if depth and not (open_nodes and open_nodes[-1][1] == depth):
            open_nodes.append((begin, depth))
    return out


def deep_nodes(suffixes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the suffixes of a group, and where each node at full depth starts in it.

    ``suffixes`` holds the words of a suffix, down to the depth that matters, as bytes. Neighbours whose common
    prefix has full depth hang below one node, an internal one if there are several; their ``check`` hashes must agree
    as well, as words are known by codes only.
    """
    order = np.lexsort((*_as_words(check)[::-1], *_as_words(suffixes)[::-1]))
    deep = common_prefixes(suffixes[order]) == suffixes.shape[1] // CODE_BYTES
    sealed = check[order]
    deep[1:] &= (sealed[1:] == sealed[:-1]).all(1)
    return order, np.flatnonzero(~deep)


def _as_words(rows: np.ndarray) -> list[np.ndarray]:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(np.ascontiguousarray(wide).view(">u8").astype(np.uint64).T)


def repeats(bucketed: DataFrame, facts: DataFrame, heavy: list[np.ndarray], groups: int, window: int) -> DataFrame:
    """Pass 2: ``_bucket, places``, the starts of windows that a smaller document of another bucket has."""
    fan, wide = FAN, CODE_BYTES * window
    kinds = ((np.uint8, wide), (np.uint8, CHECK_BYTES), (np.int64, 1), (np.uint32, 1), (np.uint32, 1))

    def send(table: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if table.num_rows:
            b = Bucket(table, found, window)
            b.sort_windows()
            here = np.zeros(len(b.words), bool)
            here[_places(found)] = True
            hit = np.zeros(len(b.heads), bool)
            hit[b.group[here[b.at[b.sorted]]]] = True
            own = b.sorted[hit[b.group] & (b.doc[b.sorted] == b.least[b.group])]
            at, doc = b.at[own], b.doc[own]
            codes = _codes(b.words, at, window)
            group = prefix_groups(codes, heavy, groups)
            raw = np.ascontiguousarray(codes.astype(f">u{CODE_BYTES}")).view(np.uint8).reshape(len(codes), wide)
            check = np.ascontiguousarray(b.value[own].astype(">u8")).view(np.uint8).reshape(-1, 8)
            order = np.lexsort((*_as_words(raw)[::-1], group))
            owner = np.full(len(order), table.column("_bucket")[0].as_py(), np.uint32)
            rows = deal(group[order], [raw[order], check[order], doc[order], at[order].astype(np.uint32), owner], groups, fan)
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "sent": pa.array([s for _, s in rows], pa.binary())})

    def grow(table: pa.Table) -> pa.Table:
        raw, check, doc, place, owner = (np.concatenate(x) for x in zip(*(_unpack(blob, *kinds) for blob in table.column("sent").to_pylist())))
        order, heads = deep_nodes(raw, check)
        doc, place, owner = doc[order], place[order], owner[order]
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(heads, append=len(doc)))
        gone = doc > least
        out = _by_owner(owner[gone], place[gone])
        return pa.table({"_bucket": pa.array([o for o, _, _ in out], pa.int32()), "places": pa.array([p for _, p, _ in out], pa.binary())})

    sent = bucketed.groupBy("_bucket").cogroup(facts.groupBy("_bucket")).applyInArrow(send, "part int, sent binary")
    return exchange(sent, groups, kinds, fan).groupBy("part").applyInArrow(grow, "_bucket int, places binary")


def _sample_codes(docs: DataFrame, rows: int, window: int, text_col: str, id_col: str, groups: int, per_doc: int = 32, most: int = 1_000_000) -> np.ndarray:
    """Word codes of windows of a sample of documents, ``per_doc`` at most of each; they only shape groups.

    About 2000 documents, more where there are many groups: 16 windows for each group, ``most`` windows at most.
    """
    max_docs = max(2000, min(16 * groups, most) // per_doc)

    def pick(batches):
        for batch in slices(batches):
            out = []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                hashed, _ = hash_words(t or b"", np.zeros(0, np.int64))
                n = len(hashed) - window + 1
                if n > 0:
                    out.append(_codes(hashed, np.unique(np.linspace(0, n - 1, per_doc).astype(np.int64)), window).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["codes"])

    step = max(1, rows // max_docs)
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(step)) == 0).select(F.col(text_col).cast("string"))
    found = some.mapInArrow(pick, "codes binary").limit(2 * max_docs).collect()
    return np.frombuffer(b"".join(bytes(r.codes) for r in found), np.uint32).reshape(-1, window)


def remove_repeats(docs: DataFrame, emit, schema: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Find the repeats and give each bucket to ``emit(table, order, texts, keeps)``, which makes the result's rows.

    ``table`` has ``_id, _text`` and the columns ``more``; ``order`` is the order of its rows to which the lists
    ``texts`` (bytes or None) and ``keeps`` (a mask of words, None where all stay) belong.
    """
    spark = small_batches(docs).sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("b")).first()
    least = shuffle_partitions(spark)
    count = max(least, -(-int(size.b) // BUCKET_BYTES))
    plain = _bucketed(docs, count, id_col, text_col)
    none = F.lit(None).cast("array<long>")
    with_lists = lambda df: df.select("_bucket", "places", none.alias("copy_ids"), none.alias("copy_marks"))
    copies = materialise(equal_texts(plain))
    candidates = materialise(repeat_candidates(plain, copies, max(least, -(-int(size.b) // RANGE_BYTES)), window))
    found = candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    groups = max(least, -(-int(found) // GROUP_SUFFIXES))
    heavy = heavy_prefixes(_sample_codes(docs, size.n, window, text_col, id_col, groups), groups)
    gone = materialise(repeats(plain, copies.union(with_lists(candidates)), heavy, groups, window))

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return emit(table, np.zeros(0, np.int64), [], [])
        b = Bucket(table, found, window)
        b.sort_windows()
        leads = np.zeros(len(b.words) + window, np.int64)
        starts = np.union1d(_places(found), b.repeated_here())
        leads[starts] = 1
        leads[starts + window] -= 1
        stays = np.cumsum(leads)[: len(b.words)] == 0
        keeps = []
        for text, copy, first, n in zip(b.texts, b.copy.tolist(), b.firsts.tolist(), b.counts.tolist()):
            own = stays[first : first + n]
            if copy:
                n = len(text.split())
                own = np.full(n, n < window)
            keeps.append(None if own.all() else own)
        return emit(table, b.order, b.texts, keeps)

    full = _bucketed(docs, count, id_col, text_col, *more)
    return full.groupBy("_bucket").cogroup(copies.union(with_lists(gone)).groupBy("_bucket")).applyInArrow(finish, schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without words covered by a window of ``window`` words that a document with a smaller id has too.

    Texts that lose words become the kept words joined by one space, all others stay as they are; all rows and
    all other columns stay. Windows are judged on the input. Ids must be integers; a null id is larger than all
    others; rows that repeat an id are one document. A null, empty or short text has no window. Columns starting
    with an underscore are reserved. An empty table gives an empty result.
    """
    schema = docs.schema

    def emit(table: pa.Table, order: np.ndarray, texts: list, keeps: list) -> pa.Table:
        new = [t if k is None else b" ".join([w for w, stays in zip(t.split(), k.tolist()) if stays]) for t, k in zip(texts, keeps)]
        own = table.take(pa.array(order))
        columns = [pa.array(new, pa.binary()).cast(pa.string()) if c == text_col else own.column(c) for c in schema.names]
        return pa.table(dict(zip(schema.names, columns)))

    others = tuple(c for c in schema.names if c != text_col)
    return remove_repeats(docs, emit, schema, window, id_col, text_col, others)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def emit(table: pa.Table, order: np.ndarray, texts: list, keeps: list) -> pa.Table:
        n, gone, sha = [], [], []
        for t, k in zip(texts, keeps):
            words = (t or b"").split()
            left = words if k is None else [w for w, stays in zip(words, k.tolist()) if stays]
            n.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
        ids = table.column("_id").take(pa.array(order))
        return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return remove_repeats(docs, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 12], ' ')) AS h FROM p),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS least FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM m WHERE least < doc_id),
d AS (SELECT doc_id, list(pos) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id),
e AS (SELECT w.doc_id, words, d.n_removed, CASE WHEN d.gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(d.gone, i)) END AS kept FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e
"""
