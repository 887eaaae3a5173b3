"""Near copies by SimHash anchors, shared rare shingles and verified similarity.

Fingerprints of short shingles find candidates with a wide threshold; the similarity of sets of longer shingles
decides. Three blocks of each fingerprint have anchors of their own: of a pair within ``threshold`` bits one
block at least differs by a third of them at most, so each block is covered with radius plus that third.

SimHash finds most links cheaply, but no number of bits holds for all pairs of one similarity. What it leaves in
different groups is searched exactly: in any one order of all shingles, similar sets share one of the first
``n - ceil(similarity * n) + 1`` shingles of each (prefix filter). The order puts rare shingles first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise, slices, small_batches
from .components import connected_components
from .simhash import DATA_BITS, LENGTH, LOWER, RADIUS, ROUTE, _syndrome, ball, cells, close_pairs, fingerprint, grid_sizes

#: The bits of the three blocks; the last one is filled up with zeros.
BLOCKS = ((0, LENGTH), (LENGTH, LENGTH), (2 * LENGTH, 64 - 2 * LENGTH))
#: Counters in the sketch of a shingle set.
COUNTERS = 64
#: Counters for the frequencies of shingles, and how many of them are one row.
BUCKET_BITS, CHUNK = 20, 4096
#: How many of its nearest candidates by fingerprint a node is compared with, in two rounds; the search by shingles
#: finds what they leave.
NEAREST = (1, 8)
#: Nodes of one shingle beyond so many are dealt into parts.
PART_ROWS = 2000
#: One document of so many is counted; frequencies only choose the order of shingles, any order gives the same result.
COUNTED = 8


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(LOWER).split()


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    """The distinct XXH64 values of the shingles of a text; a shorter text is one shingle, an empty one has none."""
    words = words_of(raw)
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64)).view(np.int64)


def sketch(items: np.ndarray) -> bytes:
    """How many shingles fall into each of COUNTERS classes, 255 at most, after their number.

    Two sketches never differ by more than the sets do, so what they rule out is not similar.
    """
    counts = np.bincount((items.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=COUNTERS)
    return len(items).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float, step: int = 100_000) -> np.ndarray:
    """For rows of sketches, whether the sets may have a Jaccard similarity of ``similarity``."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        size = (np.ascontiguousarray(x[:, :4]).view("<u4") + np.ascontiguousarray(y[:, :4]).view("<u4"))[:, 0].astype(np.float64)
        apart = np.abs(x[:, 4:].astype(np.int16) - y[:, 4:]).sum(1)
        out[lo : lo + step] = apart <= size * (1 - similarity) / (1 + similarity) + 1e-6
    return out


def block_words(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in BLOCKS]


def block_anchors(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, block and anchor, whether it is the block's own anchor) for every anchor in reach of a block."""
    starts, patterns, weights = ball(reach)
    parts = []
    for b, word in enumerate(block_words(fp)):
        syndrome = _syndrome(word)
        n = starts[syndrome + 1] - starts[syndrome]
        at = np.repeat(np.arange(len(fp)), n)
        entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[syndrome], n)
        parts.append((at, b * ROUTE + ((word[at] ^ patterns[entry]) >> (LENGTH - DATA_BITS)), weights[entry] <= RADIUS))
    return tuple(np.concatenate(x) for x in zip(*parts))


def own_codewords(fp: np.ndarray) -> list[np.ndarray]:
    """The anchor of each block, as the word of the code that lies within RADIUS bits."""
    starts, patterns, _ = ball(0)
    return [word ^ patterns[starts[_syndrome(word)]] for word in block_words(fp)]


def candidate_links(nodes: DataFrame, active: DataFrame, threshold: int, similarity: float, each: int, group_rows: int = 200_000) -> DataFrame:
    """For each active node ``each`` of its candidates, the nearest ones: ``a, b``, distinct.

    ``nodes``: tid, fp, label, sketch; ``active``: the same and ``tested``, the nodes that were compared with it
    already. Candidates are within ``threshold`` bits, of another label, not tested and not ruled out by their
    sketches, where both have one. An anchor with more than ``group_rows`` own rows or copies is cut into a grid.
    """
    reach = threshold // 3

    def anchors_of(batch):
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fp), 2_000):
            yield block_anchors(fp[a : a + 2_000], reach)[1:]

    lines, columns = grid_sizes(nodes.select("fp"), anchors_of, len(BLOCKS) * ROUTE, group_rows, group_rows)

    def deal(own: bool):
        def run(batches):
            for batch in slices(batches, 2000):
                tid, fp, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                at, anchor, mine = block_anchors(fp.view(np.uint64), reach)
                if own:
                    at, anchor = at[mine], anchor[mine]
                row, key = cells(fp.view(np.uint64)[at], lines, columns, anchor, own)
                at = at[row]
                tested = batch.column(4).take(pa.array(at)) if not own else pa.nulls(len(at), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tid[at]), pa.array(fp[at]), pa.array(label[at]), batch.column(3).take(pa.array(at)), tested], names=["key", "tid", "fp", "label", "sketch", "tested"])

        return run

    schema = "key long, tid long, fp long, label long, sketch binary, tested array<long>"
    own = nodes.select("tid", "fp", "label", "sketch").mapInArrow(deal(True), schema)
    others = active.select("tid", "fp", "label", "sketch", "tested").mapInArrow(deal(False), schema)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, near = [], [], []
        if left.num_rows and right.num_rows:
            tid, fp, label = (left.column(c).to_numpy() for c in ("tid", "fp", "label"))
            order = np.argsort(tid)
            tid, fp, label = tid[order], fp[order].view(np.uint64), label[order]
            rtid, rfp, rlabel = (right.column(c).to_numpy() for c in ("tid", "fp", "label"))
            rfp = rfp.view(np.uint64)
            block = left.column("key")[0].as_py() // (ROUTE << 32)
            codes, words = own_codewords(fp), block_words(rfp)
            rows = lambda t: np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            known = not left.column("sketch").null_count and not right.column("sketch").null_count
            mine, theirs = (rows(left)[order], rows(right)) if known else (None, None)
            tested = right.column("tested").combine_chunks()
            hard = {k: set(tested[k].as_py() or ()) for k in np.flatnonzero(np.array(tested.value_lengths().fill_null(0))).tolist()}
            for i, j in close_pairs(fp, rfp, threshold):
                fresh = label[i] != rlabel[j]
                for e in range(block):  # a pair counts in the first block in which it meets
                    fresh &= np.bitwise_count(codes[e][i] ^ words[e][j]) > RADIUS + reach
                i, j = i[fresh], j[fresh]
                if known and len(i):
                    fit = may_be_similar(mine[i], theirs[j], similarity)
                    i, j = i[fit], j[fit]
                if not len(i):
                    continue
                d = np.bitwise_count(fp[i] ^ rfp[j])
                by = np.lexsort((i, d, j))  # for each node its candidates, the nearest first
                i, j, d = i[by], j[by], d[by]
                if hard:
                    new = np.array([tid[x] not in hard.get(y, ()) for x, y in zip(i.tolist(), j.tolist())], bool)
                    i, j, d = i[new], j[new], d[new]
                    if not len(i):
                        continue
                head = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
                few = np.arange(len(j)) - np.repeat(head, np.diff(head, append=len(j))) < each
                a.append(tid[i[few]])
                b.append(rtid[j[few]])
                near.append(d[few].astype(np.int64))
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in (("a", a), ("b", b), ("d", near))})

    pairs = own.groupBy("key").cogroup(others.groupBy("key")).applyInArrow(compare, "a long, b long, d long")
    few = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "a"))), 1, each).alias("best"))
    return few.select(F.explode("best.a").alias("a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _buckets(items: np.ndarray) -> np.ndarray:
    return (items.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> np.ndarray:
    """How often shingles of each of 2 ** BUCKET_BITS classes occur in one document of COUNTED."""

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in slices(batches):
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(total, _buckets(shingle_set(raw, shingle)), 1)
        rows = total.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    schema = "chunk long, counts binary"
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(COUNTED)) == 0).select(F.col(text_col).cast("string"))
    counts = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, np.int32).reshape(-1, CHUNK)
    for r in some.mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect():  # 4 MB at most
        counts[r.chunk] = np.frombuffer(bytes(r.counts), np.int32)
    return counts.reshape(-1)


def prefix(items: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets that are similar share one of them."""
    keep = len(items) - int(np.ceil(similarity * len(items) - 1e-6)) + 1
    return items[np.lexsort((items, counts[_buckets(items)]))[:keep]]


def prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """For each distinct text with words: ``tid, n, sketch, prefix``."""

    def run(batches):
        for batch in slices(batches, 200):
            rows, seen = [], set()
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                words = words_of(raw)
                tid = xxhash.xxh64_intdigest(b" ".join(words), 7)
                if words and tid not in seen:
                    seen.add(tid)
                    items = shingle_set(raw, shingle)
                    rows.append((tid, len(items), sketch(items), prefix(items, counts, similarity)))
            tids = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tids), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["tid", "n", "sketch", "prefix"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "tid long, n long, sketch binary, prefix array<long>").dropDuplicates(["tid"])


def prefix_links(members: DataFrame, nodes: DataFrame, similarity: float, each: int) -> DataFrame:
    """For each node ``each`` of the nodes that share a shingle of ``members`` with it: ``a, b``, distinct.

    ``members``: token, parts, tid; ``nodes``: tid, n, sketch, label, tested. Pairs have different labels, were not
    tested yet and are not ruled out by sizes or sketches; the nearest sizes come first. The nodes of a token are
    dealt into its number of parts, and every two parts meet in a group of their own, so no group grows with the table.
    """

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(0)[k].values
                tid, part, n, label = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("tid", "part", "n", "label"))
                one = part.min() == part.max()
                sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(tid), -1)
                tested = rows.field("tested")
                hard = {x: set(tested[x].as_py()) for x in np.flatnonzero(np.array(tested.value_lengths().fill_null(0))).tolist()}
                step = max(1, (1 << 20) // len(tid))
                for lo in range(0, len(tid), step):
                    j, i = np.nonzero((one | (part[lo : lo + step, None] != part)) & (label[lo : lo + step, None] != label) & (np.minimum(n[lo : lo + step, None], n) >= similarity * np.maximum(n[lo : lo + step, None], n) - 1e-6))
                    j += lo
                    fit = may_be_similar(sketches[i], sketches[j], similarity)
                    i, j = i[fit], j[fit]
                    if hard:
                        new = np.array([tid[x] not in hard.get(y, ()) for x, y in zip(i.tolist(), j.tolist())], bool)
                        i, j = i[new], j[new]
                    if not len(i):
                        continue
                    d = np.abs(n[i] - n[j])
                    by = np.lexsort((i, d, j))
                    i, j, d = i[by], j[by], d[by]
                    head = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
                    few = np.arange(len(j)) - np.repeat(head, np.diff(head, append=len(j))) < each
                    yield pa.RecordBatch.from_arrays([pa.array(tid[i[few]]), pa.array(tid[j[few]]), pa.array(d[few])], names=["a", "b", "d"])

    dealt = members.join(nodes, "tid").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.groupBy("token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(F.sort_array(F.collect_list(F.struct("tid", "part", "n", "label", "sketch", "tested"))).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    # shingles with the same nodes give the same pairs
    groups = rows.where("lo <> hi").groupBy(F.xxhash64("rows.tid", "rows.part").alias("h"), F.xxhash64(F.reverse("rows.tid")).alias("g")).agg(F.first("rows").alias("rows"))
    pairs = groups.select("rows").mapInArrow(compare, "a long, b long, d long")
    few = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "a"))), 1, each).alias("best"))
    return few.select(F.explode("best.a").alias("a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 2, threshold: int = 8, shingle: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, component_id``: rows whose texts are linked by a similarity of ``similarity`` or more share the smallest id.

    The similarity is that of the sets of ``shingle``-word shingles (A-Z lower-cased, words cut at ASCII white
    space). Equal word sequences are one node. Pairs of nodes within ``threshold`` bits of their ``width``-word
    SimHash are candidates first, of which each node is compared with the nearest few (NEAREST). Then come all pairs
    that share a shingle of their prefixes, which every similar pair does: in rounds, every node is compared with some
    candidates that have another label and were not compared with it yet, the nearest first and sixteen times as many
    each round, until none are left. So all similar pairs take effect, but members of one group are not compared with
    each other again and again.
    Texts without words are one node. Null ids are larger than all others; repeated rows are repeated; other
    columns are ignored; an empty table gives an empty result.
    """

    def look(batches):
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            tid = np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t)), 7) for t in texts], np.uint64).view(np.int64)
            fp = np.frombuffer(b"".join(fingerprint(t, width, seed) for t in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tid), pa.array(fp)], names=["doc_id", "tid", "fp"])

    kind = dict(small_batches(docs).dtypes)[id_col]
    text = F.col(text_col).cast("string")
    marks = materialise(docs.select(F.col(id_col), text).mapInArrow(look, f"doc_id {kind}, tid long, fp long"))
    nodes = materialise(marks.groupBy("tid").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")))
    labelled = nodes.select("tid", "fp", F.col("tid").alias("label"), F.lit(None).cast("binary").alias("sketch"))
    none = F.array().cast("array<long>")
    active = labelled.withColumn("tested", none)
    passed, failed, sets, labels = None, None, None, None

    def verify(found: DataFrame, sets: DataFrame) -> None:
        """Compare the sets of the pairs found, and bring the links, the failures and the labels up to date."""
        nonlocal passed, failed, labels
        x, y = sets.select(F.col("tid").alias("a"), F.col("items").alias("x")), sets.select(F.col("tid").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        alike = both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9
        checked = materialise(found.join(x, "a").join(y, "b").select("a", "b", alike.alias("alike")))
        new = checked.where("alike").select(F.col("a").alias("u"), F.col("b").alias("v"))
        passed = new if passed is None else passed.union(new)
        bad = checked.where("NOT alike").select("a", "b")
        bad = bad.union(bad.select(F.col("b").alias("a"), F.col("a").alias("b")))
        failed = bad if failed is None else failed.union(bad)
        labels = materialise(connected_components(passed))

    def relabel(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("tid"))
        return rows.drop("label").join(labels.select(F.col("node").alias("tid"), "label"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))

    def with_tested(rows: DataFrame) -> DataFrame:
        if failed is None:
            return rows.withColumn("tested", none)
        tested = failed.groupBy("a").agg(F.collect_set("b").alias("tested")).withColumnRenamed("a", "tid")
        return rows.join(tested, "tid", "left").withColumn("tested", F.coalesce("tested", none))

    for each in NEAREST:
        found = materialise(candidate_links(labelled, active, threshold, similarity, each))
        if found.isEmpty():
            break
        ends = _ends(found)
        if sets is None:  # every node with a candidate takes part in the first round
            sets = materialise(_sets(docs, nodes.join(ends, "tid", "left_semi"), shingle, id_col, text_col))
            labelled = materialise(labelled.drop("sketch").join(sets.select("tid", "sketch"), "tid"))
        verify(found, sets)
        labelled = materialise(relabel(labelled).select("tid", "fp", "label", "sketch"))
        active = materialise(with_tested(labelled.join(ends, "tid", "left_semi")))

    first = materialise(prefixes(docs, shingle_counts(docs, shingle, id_col, text_col), shingle, similarity, text_col))
    token = relabel(first.select("tid", F.explode("prefix").alias("token")))
    parts = F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")
    shared = token.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), parts).where("lo <> hi").select("token", "parts")
    members = materialise(first.select("tid", F.explode("prefix").alias("token")).join(shared, "token"))
    taking = materialise(first.select("tid", "n", "sketch").join(members.select("tid").distinct(), "tid", "left_semi"))
    each, every = 4, None
    while True:
        found = materialise(prefix_links(members, with_tested(relabel(taking)), similarity, each))
        if found.isEmpty():
            break
        begun, every = every is not None, materialise(_ends(found))
        if not begun:  # every node with a candidate takes part in the first round
            members, taking = (materialise(x.join(every, "tid", "left_semi")) for x in (members, taking))
        ends = every
        if sets is not None:
            ends = ends.join(sets.select("tid"), "tid", "left_anti")
        new = materialise(nodes.join(ends, "tid", "left_semi"))
        if not new.isEmpty():
            more = materialise(_sets(docs, new, shingle, id_col, text_col))
            sets = more if sets is None else sets.union(more)
        verify(found, materialise(sets.join(every, "tid", "left_semi")))
        each *= 16
    if labels is None:
        return marks.join(nodes.select("tid", "least"), "tid").select("doc_id", F.col("least").alias("component_id"))
    named = relabel(nodes.select("tid", "least"))
    best = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return marks.join(named.join(best, "label").select("tid", "component_id"), "tid").select("doc_id", "component_id")


def _ends(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("tid")).union(found.select(F.col("b").alias("tid"))).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The shingle set of each node, from the text of its document with the smallest id: ``tid, items, sketch``."""

    def read(batches):
        for batch in slices(batches):
            tids, want, out = [], batch.column(0).to_pylist(), []
            for tid, raw in zip(want, batch.column(1).cast(pa.binary()).to_pylist()):
                if np.uint64(xxhash.xxh64_intdigest(b" ".join(words_of(raw)), 7)).view(np.int64) == tid:  # an id may have several texts
                    tids.append(tid)
                    out.append(shingle_set(raw, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array([sketch(x) for x in out], pa.binary())], names=["tid", "items", "sketch"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(nodes.select("tid", "least"), F.col("_id").eqNullSafe(F.col("least"))).select("tid", "_text")
    return rows.mapInArrow(read, "tid long, items array<long>, sketch binary").dropDuplicates(["tid"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns."""
    found = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(F.col("_first")), "left_semi")
