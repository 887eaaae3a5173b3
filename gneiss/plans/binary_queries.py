"""Queries that send table rows through the binary operators and back: packed, sealed, laid out as tree leaves, decoded."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.functions import codecs, crypto
from gneiss.sources import decode

from .catalog import query, table

BLOCK = 4096


def pack_blob(raw: bytes, kind: int, payload: bytes) -> bytes:
    return b"fpmc" + kind.to_bytes(4, "little") + len(raw).to_bytes(8, "little") + payload


def literal_stream(raw: bytes) -> bytes:
    """An LZVN stream of literals only."""
    out = []
    for at in range(0, len(raw), 271):
        part = raw[at : at + 271]
        if len(part) >= 16:
            out.append(bytes((0xF0, len(part) - 16)) + part)
        elif part:
            out.append(bytes((0xE0 | len(part) - 1,)) + part)
    return b"".join(out) + b"\x06"


def _mapped(df: DataFrame, f, name: str = "content") -> DataFrame:
    """``df(id, bytes)`` with ``f`` applied to the bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if b is None else f(i, b) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.binary())], names=["doc_id", name])

    return df.mapInArrow(run, f"doc_id long, {name} binary")


def texts(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.col("text").cast("binary"))


ROUND_TRIP = "SELECT doc_id, 'decoded' AS how, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents WHERE text <> ''"


def _unpacked(blobs: DataFrame) -> DataFrame:
    return codecs.unpack_blobs(blobs).select("doc_id", "how", F.octet_length("decoded").cast("long").alias("size"), F.sha2("decoded", 256).alias("digest"))


@query(ROUND_TRIP)
def zlib_roundtrip(spark, d):
    return _unpacked(_mapped(texts(spark, d), lambda i, b: pack_blob(b, 3 + i % 2, zlib.compress(b, 1) if i % 3 else zlib.compress(b, 1)[2:-4])))


@query(ROUND_TRIP)
def lzvn_decode(spark, d):
    return _unpacked(_mapped(texts(spark, d), lambda i, b: pack_blob(b, 7, literal_stream(b))))


@query(ROUND_TRIP)
def lzfse_wrapped_decode(spark, d):
    def wrap(i: int, b: bytes) -> bytes:
        s = literal_stream(b)
        return pack_blob(b, 11, b"bvx-" + len(b).to_bytes(4, "little") + b if i % 2 else b"bvxn" + len(b).to_bytes(4, "little") + len(s).to_bytes(4, "little") + s)

    # a limit above the size, as blobs of unknown size have it, would change nothing: the blocks carry their own
    return _unpacked(_mapped(texts(spark, d), wrap))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def xts_decrypt(spark, d):
    key = bytes(range(32))
    seal = lambda i, b: crypto.SectorCipher(key[:16], key[16:]).encrypt(len(b).to_bytes(8, "little") + b + bytes(-(len(b) + 8) % 512), i * 8)

    def unseal(i: int, b: bytes) -> bytes:
        plain = crypto.SectorCipher(key[:16], key[16:]).decrypt(b, i * 8)
        return plain[8 : 8 + int.from_bytes(plain[:8], "little")]

    return _mapped(_mapped(texts(spark, d), seal), unseal).select("doc_id", F.sha2("content", 256).alias("digest"))


def leaf_block(records: list[tuple[bytes, bytes]], xid: int) -> bytes:
    """A leaf node that holds the (key, value) records."""
    base = 56 + 8 * len(records)
    keys, toc, used = b"", b"", 0
    block = bytearray(BLOCK)
    for k, v in records:
        used += len(v)
        toc += struct.pack("<4H", len(keys), len(k), used, len(v))
        block[BLOCK - used : BLOCK - used + len(v)] = v
        keys += k
    struct.pack_into("<QQQII", block, 0, 0, 1, xid, 2, 0)
    struct.pack_into("<HHIHH", block, 32, 2, 0, len(records), 0, 8 * len(records))
    block[56:base] = toc
    block[base : base + len(keys)] = keys
    return bytes(block)


def customer_blocks(spark, d: str) -> DataFrame:
    """Customers as directory records, inodes and extents, twelve to a leaf; their nation is the parent."""

    def run(table_: pa.Table) -> pa.Table:
        rows = sorted(table_.to_pylist(), key=lambda r: r["c_custkey"])
        records = []
        for r in rows:
            own, name = r["c_custkey"], r["c_name"].encode() + b"\0"
            records.append((struct.pack("<QI", r["c_nationkey"] | 9 << 60, len(name)) + name, struct.pack("<QQH", own, 0, 8)))
            records.append((struct.pack("<Q", own | 3 << 60), struct.pack("<QQQQQQ", r["c_nationkey"], own, 10**18, 10**18, 10**18, 10**18) + bytes(32) + struct.pack("<H", 0o100644) + bytes(10)))
            records.append((struct.pack("<QQ", own | 8 << 60, 0), struct.pack("<QQQ", own * 512, own + 7, 0)))
        n = rows[0]["c_custkey"] // 12
        return pa.table({"block_num": pa.array([n], pa.int64()), "ok": pa.array([True]), "bytes": pa.array([leaf_block(records, n + 1)], pa.binary())})

    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").groupBy(F.expr("c_custkey div 12")).applyInArrow(run, "block_num long, ok boolean, bytes binary")


@query("SELECT c_nationkey::BIGINT AS parent_inode, c_custkey AS file_inode, c_name AS name, false AS is_dir, c_custkey // 12 AS block_num FROM customer")
def btree_decode(spark, d):
    return decode.directory_entries(decode.decode_entries(customer_blocks(spark, d), BLOCK)).select("parent_inode", "file_inode", "name", "is_dir", "block_num")


@query("SELECT c_custkey AS inode_id, c_nationkey::BIGINT AS parent_id, 33188 AS mode, 1000000000000000000 AS mod_ns FROM customer")
def inode_decode(spark, d):
    return decode.inode_facts(decode.decode_entries(customer_blocks(spark, d), BLOCK)).select("inode_id", "parent_id", "mode", "mod_ns")


@query("SELECT c_custkey AS inode_id, 0::BIGINT AS logical, c_custkey + 7 AS physical, c_custkey * 512 AS length FROM customer WHERE c_custkey // 12 >= 20")
def extent_decode_min_xid(spark, d):
    return decode.extent_facts(decode.decode_entries(customer_blocks(spark, d), BLOCK, min_xid=21)).select("inode_id", "logical", "physical", "length")


@query("SELECT block_num, block_num + 1 AS xid FROM (SELECT DISTINCT c_custkey // 12 AS block_num FROM customer)")
def node_transactions(spark, d):
    return decode.node_transactions(customer_blocks(spark, d))
