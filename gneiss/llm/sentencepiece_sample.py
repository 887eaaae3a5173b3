"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, slices, small_batches

#: A piece holds spaces at its start or nothing but spaces, and no line feed, so the lattice of a text is a chain
#: of the lattices of these chunks. Models with other pieces are refused.
CHUNK = re.compile(r" *[^ \n]+|\n| +")
ONE = 1 << 31  # probabilities are counted in units of 1 / ONE, so samples do not depend on batches


class PieceBytes:
    """The bytes behind each id of a model file: all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.texts: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("\u2581", " ")
                if not CHUNK.fullmatch(text):
                    raise ValueError(f"piece {i} spans chunks: {text!r}")
                self.bytes_of.append(text.encode())
                self.texts[text] = i
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces: not all texts can be encoded without loss")
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all lists of ids one after another, and where each list's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at].tobytes(), np.concatenate(([0], ends))[offsets]


class Pieces(PieceBytes):
    """The pieces of a model file as an automaton with dense moves, their weights, and the bytes behind each id."""

    def __init__(self, path: str, alpha: float):
        super().__init__(path)
        # Scores of a merge-based model are merge ranks, not log-probabilities: take Zipf's law over them.
        self.weights = np.zeros(len(self.bytes_of))
        self.weights[list(self.texts.values())] = -alpha * np.log(2 + np.arange(len(self.texts)))
        self.fallback = np.array([self.byte_id[b] for b in range(256)], np.int32)
        self.byte_weight = -alpha * math.log(2 + len(self.texts))
        self.first = np.zeros(0x110000, np.int32)
        self.kind = np.zeros(0x110000, np.int16)
        later = sorted({c for t in self.texts for c in t[1:]})
        for k, c in enumerate(later, 1):
            self.kind[ord(c)] = k
        state = {"": 0}
        for t in self.texts:
            for n in range(1, len(t) + 1):
                state.setdefault(t[:n], len(state))
        self.move = np.zeros((len(state), len(later) + 1), np.int32)
        self.piece = np.full(len(state), -1, np.int32)
        for t, at in state.items():
            if len(t) == 1:
                self.first[ord(t)] = at
            elif t:
                self.move[state[t[:-1]], self.kind[ord(t[-1])]] = at
            self.piece[at] = self.texts.get(t, -1)

    def edges(self, chunks: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges of the chunks, sorted by end node: start node, end node, piece (-1: bytes), log weight.

        The nodes of chunk k are its character boundaries, numbered from the first character of k plus k.
        """
        text = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(chunks)), length)
        room = np.repeat(np.cumsum(length), length) - np.arange(len(text))  # characters up to the end of the chunk
        at, state = np.arange(len(text)), self.first[text]
        kinds = self.kind[text]
        starts, widths, ids = [], [], []
        piece = self.piece[state]
        bare = piece < 0
        bare[state == 0] = True
        starts += [at[~bare], at[bare]]
        widths += [1, 1]
        ids += [piece[~bare], np.full(int(bare.sum()), -1, np.int32)]
        depth = 1
        while True:
            go = (state > 0) & (room > depth)
            at, state, room = at[go], state[go], room[go]
            if not len(at):
                break
            state = self.move[state, kinds[at + depth]]
            depth += 1
            piece = self.piece[state]
            hit = (piece >= 0) & (state > 0)
            starts.append(at[hit])
            widths.append(depth)
            ids.append(piece[hit])
        width = np.repeat(np.array(widths), [len(s) for s in starts])
        start, piece = np.concatenate(starts), np.concatenate(ids)
        weight = self.weights[piece]
        if bare.any():
            size = np.where(text < 0x80, 1, np.where(text < 0x800, 2, np.where(text < 0x10000, 3, 4)))
            weight = np.where(piece < 0, self.byte_weight * size[start], weight)
        base = start + owner[start]
        order = np.argsort(base + width, kind="stable")
        base, width = base[order], width[order]
        return base, base + width, piece[order], weight[order]

    def filtered(self, chunks: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering. The edges sorted by end node: start node, end node, piece, and the upper bound of
        the edge's share in its end node's mass, in units of 1 / ONE.

        Masses are logarithms, and each node's shares are taken relative to its largest one, so neither rare
        characters nor any ``alpha`` or length make a mass vanish.
        """
        start, end, piece, weight = self.edges(chunks, length)
        first = np.cumsum(length + 1) - (length + 1)
        node_place = np.arange(int((length + 1).sum())) - np.repeat(first, length + 1)
        head = np.concatenate(([True], end[1:] != end[:-1]))
        place = node_place[end]
        order = np.argsort(place.astype(np.uint16), kind="stable") if length.max() < 65536 else np.argsort(place, kind="stable")
        cuts = np.cumsum(np.bincount(place))
        ahead = np.zeros(len(node_place))
        mass = np.empty(len(end))
        by_place, from_node, is_head = weight[order], start[order], head[order]
        to_node = end[order]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # all nodes at one distance from their chunk's start
            own = by_place[lo:hi] + ahead[from_node[lo:hi]]
            heads = np.flatnonzero(is_head[lo:hi])
            count = np.diff(heads, append=hi - lo)
            top = np.maximum.reduceat(own, heads)
            own = np.exp(own - np.repeat(top, count))
            total = np.add.reduceat(own, heads)
            ahead[to_node[lo:hi][heads]] = top + np.log(total)
            mass[order[lo:hi]] = own / np.repeat(total, count)
        heads = np.flatnonzero(head)
        count = np.diff(heads, append=len(end))
        run = mass
        for k in range(1, int(count.max())):  # running sums inside each node
            own = heads[count > k] + k
            run[own] += run[own - 1]
        bound = np.minimum(ONE, (run * ONE).astype(np.int64))
        bound[heads + count - 1] = ONE
        return start, end, piece, bound


@lru_cache(4)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode_batch(model: Pieces, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of one sampled segmentation of each text.

    Backward sampling walks all chunks of the batch at once: at each node an edge that ends there is drawn with
    its share of the filtered mass. The draw is a hash of the row's key and the node's place in the text, so a
    row gives the same pieces wherever and whenever it is encoded.
    """
    own = [CHUNK.findall(" " + t) if t else [] for t in texts]
    whole = list(chain.from_iterable(own))
    if not whole:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    index = {c: k for k, c in enumerate(sorted(set(whole), key=len))}
    code = np.fromiter(map(index.__getitem__, whole), np.int64, len(whole))
    held = list(index)
    length = np.fromiter(map(len, held), np.int64, len(held))
    start, end, piece, bound = model.filtered(held, length)
    nodes = np.cumsum(length + 1) - (length + 1)  # of each chunk, its first node
    entry = np.zeros(int(nodes[-1] + length[-1]) + 1, np.int64)  # of each node, its first edge
    heads = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
    entry[end[heads]] = heads

    row = np.repeat(np.arange(len(texts)), [len(o) for o in own])
    size = length[code]
    sizes = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
    origin = np.cumsum(size) - size - (np.cumsum(sizes) - sizes)[row]  # where each chunk starts in its text
    seed = _mix(keys.astype(np.int64).view(np.uint64))[row]
    first = nodes[code]
    node, active = first + size, np.arange(len(code))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(int(length[-1])):  # a chunk has as many pieces as characters at most
        if not len(active):
            break
        place = origin[active] + node - first[active]
        draw = (_mix(seed[active] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        edge = entry[node]
        late = np.flatnonzero(bound[edge] <= draw)
        while len(late):  # the last edge of a node has the bound ONE, which no draw reaches
            edge[late] += 1
            late = late[bound[edge[late]] <= draw[late]]
        steps.append((active, edge))
        node = start[edge]
        go = node > first[active]
        active, node = active[go], node[go]
    if len(active):
        raise RuntimeError("backward sampling left the lattice")
    taken = np.bincount(np.concatenate([a for a, _ in steps]), minlength=len(code))
    last = np.cumsum(taken)
    edges = np.empty(int(last[-1]), np.int64)
    for k, (a, e) in enumerate(steps):  # the k-th step backwards is the k-th piece from the end
        edges[last[a] - 1 - k] = e
    ids = piece[edges]
    n = np.ones(len(edges), np.int64)
    blank = np.flatnonzero(ids < 0)
    if len(blank):  # characters without a piece become the ids of their bytes
        at = np.repeat(np.arange(len(code)), taken)[blank]
        raw = [held[code[c]][x].encode("utf-8", "surrogatepass") for c, x in zip(at.tolist(), (start[edges[blank]] - first[at]).tolist())]
        n[blank] = [len(r) for r in raw]
        ids = np.repeat(ids, n)
        ids[ids < 0] = model.fallback[np.frombuffer(b"".join(raw), np.uint8)]
    per_chunk = np.add.reduceat(n, last - taken)
    per_row = np.bincount(row, weights=per_chunk, minlength=len(texts)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(per_row))), ids


@lru_cache(4)
def piece_bytes(path: str) -> PieceBytes:
    return PieceBytes(path)


def decode_ids(model: PieceBytes, ids) -> str:
    """The text of ids, without the space that encoding puts in front; the inverse of any sampled encoding."""
    return b"".join(map(model.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sample one segmentation of every text: ``doc_id, ids array<int>``.

    A segmentation is drawn with probability proportional to the product of its pieces' weights to the power
    ``alpha`` (larger: closer to the best one), by exact forward filtering and backward sampling over the whole
    text, seeded by ``seed`` and the row's id; characters that no piece covers become byte pieces. A null
    text gives null ids, an empty one none. Texts of any length are sampled whole. Equal ids with equal texts give equal results; a null id has a seed of
    its own; other columns are ignored. ``model_path`` must exist on every worker.
    """

    def run(batches):
        model = pieces(model_path, alpha)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(texts):
                end, room = begin, 1_000_000
                while end < len(texts) and (room > 0 or end == begin):
                    room -= len(texts[end] or "")
                    end += 1
                offsets, ids = encode_batch(model, texts[begin:end], keys[begin:end])
                missing = pa.array([t is None for t in texts[begin:end]])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=missing)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=["doc_id", "ids"])
                begin = end

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string"), F.xxhash64(F.col(id_col), F.lit(seed))).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: the exact text that was encoded; null ids give a null text, empty ids an empty one.

    Ids outside the model are an error. Other columns are ignored; repeated rows are repeated.
    """

    def run(batches):
        model = piece_bytes(model_path)
        for batch in slices(batches):
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            raw, ends = model.decode_flat(ids, offsets - offsets[0])
            there = lists.is_valid().to_pylist()
            texts = [raw[a:b].decode("utf-8", "replace")[1:] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kinds = dict(encoded.dtypes)
    return encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"doc_id {kinds[id_col]}, ids array<int>, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """Sampled ids of every document, and the SHA-256 of the text that decoding them gives back.

    Nulls, empty and very long texts, repeated rows and empty tables: as in ``encode`` and ``decode``; a null text has
    null ``n_ids``, ``ids`` and ``decoded_sha256``.
    """
    found = decode(encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), model_path), model_path)
    count = F.when(F.col("ids").isNotNull(), F.size("ids").cast("long"))
    return found.select("doc_id", count.alias("n_ids"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
