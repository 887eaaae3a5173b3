"""From blocks to records: tree nodes to entries, entries to directory records, inodes, extents and attributes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.crypto import SECTOR, SectorCipher

from .geometry import looks_partial, looks_strict

INODE, XATTR, SIBLING, CRYPTO, EXTENT, ENTRY = 3, 4, 5, 7, 8, 9
ROOT, LEAF, FIXED = 1, 2, 4
DIRECTORY, REGULAR = 4, 8
ENTRIES = "block_num long, ord int, xid long, key_type int, key_id long, key binary, val binary, source string"
LIMIT_KEYS, TAIL = 500, 512

u16 = lambda b, o: int.from_bytes(b[o : o + 2], "little")
u32 = lambda b, o: int.from_bytes(b[o : o + 4], "little")
u64 = lambda b, o: int.from_bytes(b[o : o + 8], "little")


def as_long(n: int) -> int:
    """An unsigned 64-bit value as Spark's long keeps it."""
    return n - (1 << 64) if n >= 1 << 63 else n


@dataclass(frozen=True)
class Node:
    leaf: bool
    root: bool
    fixed: bool
    keys: int
    table: int
    xid: int


def node_header(raw: bytes) -> Node:
    flags = u16(raw, 32)
    return Node(bool(flags & LEAF), bool(flags & ROOT), bool(flags & FIXED), u32(raw, 36), u16(raw, 42), u64(raw, 16))


def node_entries(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes, str]]:
    """(type, id, key, value, source) of a leaf; ``source`` is ``table``, ``guess`` (unknown type) or ``partial``."""
    node, size = node_header(raw), len(raw)
    base = 56 + node.table
    if not node.leaf or node.table > 4000 or base >= size:
        return
    end = size - 40 if node.root and size > 40 else size
    width, found = (4, 0) if node.fixed else (8, 0)
    for i in range(min(node.keys, LIMIT_KEYS)):
        at = 56 + i * width
        if at + width > min(size, base):
            break
        key_off, key_len, val_off, val_len = (u16(raw, at), 8, u16(raw, at + 2), 16) if node.fixed else struct.unpack_from("<4H", raw, at)
        key_at, val_at = base + key_off, end - val_off
        if not key_len or not val_len or val_off > end or val_at < base or key_at + 8 > size:
            continue
        head = u64(raw, key_at)
        kind, own = head >> 60, head & (1 << 60) - 1
        key, val = raw[key_at : key_at + key_len], raw[val_at : val_at + val_len]
        source = "table"
        if kind == 0:
            kind, source = guess_kind(raw, own, key_at, val_at, val_len), "guess"
        if kind in (ENTRY, SIBLING, INODE, EXTENT):
            found += 1
        if kind in (ENTRY, SIBLING, INODE, EXTENT, XATTR, CRYPTO):
            yield kind, own, key, val, source
    if node.keys > 5 and found < node.keys // 2 and base < end:
        yield from scan_keys(raw, base, end)


#: Ids and parents of records whose type is lost are taken for real below this.
SMALL = 1 << 24


def fit(kind: int, key: bytes, val: bytes, most_id: int) -> int:
    """How well a key and a value fit together as a record of a type: 0 if not at all, more for each sign.

    ``key`` begins at the record's key and ``val`` at its value; both may go on behind it.
    """
    first = u64(val, 0) if len(val) >= 8 else None
    if first is None:
        return 0
    if kind in (ENTRY, SIBLING):
        size = u32(key, 8) & 0x3FF if len(key) >= 12 else 0
        named = 0 < size < 256 and 12 + size <= len(key)
        typed = len(val) >= 18 and u16(val, 16) & 15 in (DIRECTORY, REGULAR)
        return (2 * named + typed) if 0 < first < most_id else 0
    if kind == INODE:
        shaped = len(val) >= 82 and u16(val, 80) & 0o170000 in (0o100000, 0o040000, 0o120000)
        return (1 + shaped) if first < most_id else 0
    length = first & (1 << 56) - 1
    return 0 if length == (1 << 56) - 1 else 1 + (0 < length < 1 << 48 and length % SECTOR == 0)


def guess_kind(raw: bytes, own: int, key_at: int, val_at: int, val_len: int) -> int:
    """What an entry without a type is: the type that it fits best, a directory record before an inode; 0 for neither."""
    if own >= SMALL or val_len < 16 or val_at + 16 >= len(raw):
        return 0
    key, val = raw[key_at:], raw[val_at:]
    if fit(ENTRY, key, val, SMALL):
        return ENTRY
    return INODE if fit(INODE, key, val, SMALL) else 0


def scan_keys(raw: bytes, base: int, end: int) -> Iterator[tuple[int, int, bytes, bytes, str]]:
    """Records of a node whose table is damaged, each key with the value that fits it best.

    Every aligned word of the key area with a known type is a key, every sixteenth byte of the last TAIL bytes before
    ``end`` may begin a value. Of values that fit equally well, the one nearest to the end is taken.
    """
    last = end - TAIL if end > TAIL else base + TAIL
    words = np.frombuffer(raw, "<u8", max(0, (min(last, len(raw) - 8) - base + 7) // 8), base)
    kinds = words >> np.uint64(60)
    values = [raw[end - back :] for back in range(16, min(TAIL, end - base), 16)]
    for i in np.flatnonzero(np.isin(kinds, (ENTRY, SIBLING, INODE, EXTENT))).tolist():
        kind, key_at = int(kinds[i]), base + 8 * i
        room = end - key_at  # a value lies behind its key
        scores = [fit(kind, raw[key_at:], v, 1 << 32) if 16 * (k + 1) < room else 0 for k, v in enumerate(values)]
        best = max(scores, default=0)
        if best < (2 if kind in (ENTRY, SIBLING) else 1):  # without a name there is no directory record
            continue
        val, key = values[scores.index(best)], raw[key_at : key_at + 16]
        if kind in (ENTRY, SIBLING):
            key, val = raw[key_at : key_at + 12 + (u32(raw, key_at + 8) & 0x3FF)], val[:18]
        elif kind == EXTENT:
            val = val[:16]
        yield kind, int(words[i]) & (1 << 60) - 1, key[:8] if kind == INODE else key, val, "partial"


def block_rows(column: pa.Array, size: int) -> np.ndarray:
    """The blocks of a column as rows of bytes; a block of another size is an error."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if (np.diff(offsets) != size).any():
        raise ValueError("blocks of different sizes")
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, size) if len(column) else np.zeros((0, size), np.uint8)


def header_fields(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """flags, level, number of keys, table space of each block."""
    head = np.ascontiguousarray(rows[:, 32:44])
    return head[:, 0:2].copy().view("<u2")[:, 0], head[:, 2:4].copy().view("<u2")[:, 0], head[:, 4:8].copy().view("<u4")[:, 0], head[:, 10:12].copy().view("<u2")[:, 0]


def strict_rows(rows: np.ndarray) -> np.ndarray:
    """``looks_strict`` of many blocks at once."""
    flags, level, keys, _ = header_fields(rows)
    return ((flags & 7) > 0) & (level <= 15) & (keys >= 1) & (keys <= 500)


def leaf_rows(rows: np.ndarray) -> np.ndarray:
    return (header_fields(rows)[0] & LEAF) > 0


def lenient_rows(rows: np.ndarray) -> np.ndarray:
    """``looks_partial`` of many blocks at once: headers first, key areas of what is left."""
    flags, level, keys, table = header_fields(rows)
    able = ((flags & 7) > 0) & (level <= 15) & (keys <= 500) & (table <= 4000)
    for k in np.flatnonzero(able).tolist():
        able[k] = looks_partial(rows[k].tobytes())
    return able


def picked_leaves(rows: np.ndarray, sectors: np.ndarray, cipher: SectorCipher | None) -> Iterator[tuple[int, bytes]]:
    """The blocks that are leaves, as (row, bytes): as they are, decrypted, or as they are under the lenient test."""
    strict = strict_rows(rows)
    as_is = strict & leaf_rows(rows)
    rest = ~strict if cipher is None else ~as_is
    opened: dict[int, bytes] = {}
    if cipher is not None:
        at = np.flatnonzero(rest)
        plain = cipher.decrypt_blocks(rows[at], sectors[at])
        good = strict_rows(plain) & leaf_rows(plain)
        opened = {int(k): plain[i].tobytes() for i, k in zip(np.flatnonzero(good).tolist(), at[good].tolist())}
    able = ~strict & leaf_rows(rows)
    able[list(opened)] = False
    able[able] = lenient_rows(rows[able])
    for k in range(len(rows)):
        if as_is[k] or able[k]:
            yield k, rows[k].tobytes()
        elif k in opened:
            yield k, opened[k]


def pick_node(raw: bytes) -> bool:
    """Whether a plain block is a leaf by either test."""
    return bool(node_header(raw).leaf and (looks_strict(raw) or looks_partial(raw)))


def decode_entries(blocks: DataFrame, block_size: int, volume_key: bytes | None = None, min_xid: int = 0) -> DataFrame:
    """All records of all leaves with a transaction of at least ``min_xid``; other blocks give nothing.

    Headers are tested, and blocks of encrypted volumes opened, a batch at a time; only leaves are read one by one.
    """
    each = block_size // SECTOR

    def run(batches):
        cipher = SectorCipher(volume_key[:16], volume_key[16:]) if volume_key else None
        for batch in batches:
            numbers, ok = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            whole = block_rows(batch.column(2), block_size)
            there = np.flatnonzero(ok)
            rows: list[tuple] = []
            for k, raw in picked_leaves(whole[there], numbers[there] * each, cipher):
                xid, n = node_header(raw).xid, int(numbers[there[k]])
                if xid >= min_xid:
                    rows += [(n, i, as_long(xid), kind, own, key, val, source) for i, (kind, own, key, val, source) in enumerate(node_entries(raw))]
            yield _batch(rows, ("block_num", "ord", "xid", "key_type", "key_id", "key", "val", "source"), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()))

    return blocks.select("block_num", "ok", "bytes").mapInArrow(run, ENTRIES)


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _relation(entries: DataFrame, kinds: tuple[int, ...], schema: str, parse: Callable[[int, bytes, bytes], tuple | None]) -> DataFrame:
    """Decode the entries of some types; every row also has the place it comes from."""
    whole = schema + ", block_num long, ord int"
    names, types = zip(*(c.strip().split(" ") for c in whole.split(",")))

    def run(batches):
        for batch in batches:
            rows = []
            for n, i, own, key, val in zip(*(batch.column(c).to_pylist() for c in ("block_num", "ord", "key_id", "key", "val"))):
                row = parse(own, key, val)
                if row is not None:
                    rows.append((*row, n, i))
            yield _batch(rows, names, tuple(_ARROW[t] for t in types))

    return entries.where(F.col("key_type").isin(*kinds)).select("block_num", "ord", "key_id", "key", "val").mapInArrow(run, whole)


def parse_entry(own: int, key: bytes, val: bytes) -> tuple | None:
    if len(key) < 12 or len(val) < 18:
        return None
    size = min(u32(key, 8) & 0x3FF, len(key) - 12)
    raw = key[12 : 12 + size].split(b"\0")[0][:255]
    return own, as_long(u64(val, 0)), raw.decode("utf-8", "replace"), raw, u16(val, 16) & 15 == DIRECTORY


def directory_entries(entries: DataFrame, sibling_as_entry: bool = True) -> DataFrame:
    return _relation(entries, (ENTRY, SIBLING) if sibling_as_entry else (ENTRY,), "parent_inode long, file_inode long, name string, name_raw binary, is_dir boolean", parse_entry)


def parse_fields(val: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the extended fields of an inode value: the count at 92, or at 84 if that is implausible."""
    for at in (92, 84):
        count = u16(val, at) if at + 4 <= len(val) else 0
        if 1 <= count <= 19:
            heads = at + 4
            data = heads + 4 * count
            for i in range(min(count, 10)):
                head = val[heads + 4 * i : heads + 4 * i + 4]
                if len(head) < 4:
                    return
                size = u16(head, 2)
                if data + size > len(val):
                    return
                yield head[0], val[data : data + size]
                data += size + 7 & ~7
            return


def parse_inode(own: int, key: bytes, val: bytes) -> tuple | None:
    num = lambda at, size: as_long(int.from_bytes(val[at : at + size], "little")) if len(val) >= at + size else None
    mode = num(80, 2)
    size = key_id = link = None
    for kind, data in parse_fields(val):
        if kind == 8 and len(data) >= 8:
            size = as_long(u64(data, 0))
            key_id = as_long(u64(data, 16)) if len(data) >= 24 else None
        elif kind == 13:
            link = data.split(b"\0")[0].decode("utf-8", "replace")
    flags = num(68, 4)
    return own, num(0, 8), num(16, 8), num(24, 8), num(32, 8), num(40, 8), flags, num(72, 4), num(76, 4), mode, mode is not None and mode & 0o170000 == 0o040000, size, key_id, link, bool((flags or 0) & 0x20)


def inode_facts(entries: DataFrame) -> DataFrame:
    return _relation(entries, (INODE,), "inode_id long, parent_id long, create_ns long, mod_ns long, change_ns long, access_ns long, bsd_flags long, uid long, gid long, mode int, is_dir boolean, size long, default_crypto_id long, symlink_target string, is_compressed boolean", parse_inode)


def parse_extent(own: int, key: bytes, val: bytes) -> tuple | None:
    if len(key) < 16 or len(val) < 16:
        return None
    field = u64(val, 0)
    return own, as_long(u64(key, 8)), as_long(u64(val, 8)), field & (1 << 56) - 1, as_long(u64(val, 16)) if len(val) >= 24 else 0, field >> 56


def extent_facts(entries: DataFrame) -> DataFrame:
    return _relation(entries, (EXTENT,), "inode_id long, logical long, physical long, length long, crypto_id long, flags int", parse_extent)


def parse_attribute(own: int, key: bytes, val: bytes) -> tuple | None:
    if len(key) < 10 or len(val) < 4:
        return None
    name = key[10 : 10 + u16(key, 8)].split(b"\0")[0].decode("utf-8", "replace")
    flags, size = u16(val, 0), u16(val, 2)
    data = val[4 : 4 + size]
    if name == "com.apple.decmpfs" and flags & 2 and len(data) >= 16:
        return own, u32(data, 4), as_long(u64(data, 8)), data if len(data) > 16 else None, None
    if name == "com.apple.fs.symlink" and data:
        return own, None, None, None, data.split(b"\0")[0].decode("utf-8", "replace")
    return None


def attribute_facts(entries: DataFrame) -> DataFrame:
    """The two attributes that matter: inline compressed data and link targets."""
    return _relation(entries, (XATTR,), "inode_id long, compression_type int, uncompressed_size long, decmpfs binary, link_attribute string", parse_attribute)


def crypto_states(entries: DataFrame) -> DataFrame:
    found = _relation(entries, (CRYPTO,), "crypto_id long, key_len int", lambda own, key, val: (own, u16(val, 22)) if len(val) >= 28 else None)
    return found.select("crypto_id").distinct()


def deleted_inodes(blocks: DataFrame, block_size: int) -> DataFrame:
    """Blocks that are no tree leaf but start like the inode of a file or directory: ``block_num, inode_id, bytes``."""

    def run(batches):
        for batch in batches:
            whole = block_rows(batch.column(2), block_size)
            words = np.ascontiguousarray(whole[:, :16]).view("<u8")
            kind = np.ascontiguousarray(whole[:, 80:82]).view("<u2")[:, 0] & 0o170000
            fits = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) & ((words > 0) & (words < 1 << 20)).all(1) & ((kind == 0o100000) | (kind == 0o040000))
            numbers = batch.column(0).to_numpy()
            rows = [(int(numbers[k]), int(words[k, 1]), whole[k].tobytes()) for k in np.flatnonzero(fits).tolist()]
            yield _batch([r for r in rows if not pick_node(r[2])], ("block_num", "inode_id", "bytes"), (pa.int64(), pa.int64(), pa.binary()))

    if block_size < 88:
        return blocks.limit(0).select("block_num", F.col("block_num").alias("inode_id"), "bytes")
    return blocks.select("block_num", "ok", "bytes").mapInArrow(run, "block_num long, inode_id long, bytes binary")


def node_transactions(blocks: DataFrame, every: int = 1) -> DataFrame:
    """``block_num, xid`` of blocks that are tree nodes by their object type, with a plausible transaction.

    ``every``: look at every so many blocks only, an even sample of the image for advice on a cut-off.
    """
    chosen = blocks.where(F.col("ok") & (F.col("block_num") % every == 0))
    found = chosen.where(_little("bytes", 24, 2) == 2).select("block_num", _little("bytes", 16, 8).alias("xid"))
    return found.where((F.col("xid") >= 1) & (F.col("xid") <= 1 << 48))


def _little(column: str, first: int, size: int) -> Column:
    """A little-endian number of a binary column, by functions of the JVM."""
    out = None
    for k in range(size):
        byte = F.shiftleft(F.conv(F.hex(F.substring(column, first + k + 1, 1)), 16, 10).cast("long"), 8 * k)
        out = byte if out is None else out.bitwiseOR(byte)
    return out
