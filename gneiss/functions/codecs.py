"""Decoders of compressed content. Each takes bytes and a size limit and returns what could be decoded, or None."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_OUTPUT = 64 * 1024 * 1024
FILE_LIMIT = 512 * 1024 * 1024
#: Compression type numbers of the header, by codec; each codec has an inline and a resource-fork number.
CODEC_OF = {1: "raw", 3: "zlib", 4: "zlib", 7: "lzvn", 8: "lzvn", 9: "raw", 10: "raw", 11: "lzfse", 12: "lzfse"}
RESOURCE_HEADER = b"\x00\x00\x01\x00"


def _copy_back(out: bytearray, distance: int, length: int, limit: int) -> bool:
    if not 0 < distance <= len(out):
        return False
    length = min(length, limit - len(out))
    if distance >= length:
        start = len(out) - distance
        out += out[start : start + length]
    else:
        unit = bytes(out[-distance:])
        out += (unit * (length // distance + 1))[:length]
    return True


def lzvn(src: bytes, limit: int) -> bytes:
    """The literal and match operations of the stream format that occur in this data; stops at anything else.

    Literals: E0-EF (1 to 16 bytes), F0 (16 and more). Matches: 00-5F (12-bit distance), 80-BF (14-bit distance).
    06 ends the stream; 60-7F and C0-DF are skipped.
    """
    out, at, end = bytearray(), 0, len(src)
    while at < end and len(out) < limit:
        op = src[at]
        at += 1
        if op == 0x06:
            break
        high = op >> 4
        if high >= 0xE:
            if high == 0xE:
                size = (op & 15) + 1
            elif op == 0xF0 and at < end:
                size = src[at] + 16
                at += 1
            else:
                break
            if at + size > end or len(out) + size > limit:
                break
            out += src[at : at + size]
            at += size
        elif high <= 5:
            if at >= end:
                break
            distance = (op & 15) << 8 | src[at]
            at += 1
            if not _copy_back(out, distance, (high & 7) + 3, limit):
                break
        elif 0x8 <= high <= 0xB:
            if at + 1 >= end:
                break
            distance = ((op & 0x30) << 4 | src[at] | src[at + 1] << 8) & 0x3FFF
            at += 2
            if not _copy_back(out, distance, (op & 15) + 3, limit):
                break
    return bytes(out)


def lzfse(src: bytes, limit: int) -> bytes | None:
    """Blocks that wrap other codecs or plain bytes; entropy-coded blocks (bvx1, bvx2) are not supported: None."""
    tag = src[:4]
    if len(src) < 4 or tag in (b"bvx1", b"bvx2"):
        return None
    if tag == b"bvxn":
        if len(src) < 12:
            return None
        plain, packed = int.from_bytes(src[4:8], "little"), int.from_bytes(src[8:12], "little")
        return lzvn(src[12 : 12 + packed], min(plain, limit)) if packed <= len(src) - 12 else None
    if tag == b"bvx-":
        size = int.from_bytes(src[4:8], "little")
        return src[8 : 8 + size] if 8 + size <= len(src) and size <= limit else None
    return lzvn(src, limit)


def inflate(src: bytes, limit: int) -> bytes | None:
    """zlib, or deflate without a header; None unless the stream ends within ``limit`` bytes."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(src, limit)
            if d.eof:
                return out
        except zlib.error:
            continue
    return None


def decode(codec: str, src: bytes, limit: int) -> bytes | None:
    out = {"raw": lambda s, n: s, "zlib": inflate, "lzvn": lzvn, "lzfse": lzfse}[codec](src, limit)
    return out or None


def parse_header(raw: bytes) -> tuple[str, bytes, int] | None:
    """(codec, payload, size if known else 0) of a blob with a compression header, else None."""
    if len(raw) < 8:
        return None
    if raw[:4] == b"fpmc":
        codec = CODEC_OF.get(int.from_bytes(raw[4:8], "little"))
        if len(raw) < 16 or codec is None:
            return None
        return codec, raw[16:], int.from_bytes(raw[8:16], "little")
    offset = raw[0]
    if raw[1:4] == b"\0\0\0" and 8 <= offset <= 96 and offset % 4 == 0:
        size = min(int.from_bytes(raw[4:8], "little"), len(raw) - offset)
        if size > 0:
            return "lzvn", raw[offset : offset + size], 0
    return None


def unpack_blob(raw: bytes, late: bool = False) -> tuple[str, bytes | None]:
    """(how, content): ``plain`` without a header, ``decoded`` or ``broken`` with one.

    ``late`` tries a simplified header at any offset that is a multiple of four.
    """
    head = parse_header(raw)
    if head is None and late and len(raw) >= 8 and raw[1:4] == b"\0\0\0" and raw[0] >= 8 and raw[0] % 4 == 0 and raw[0] < len(raw):
        size = min(int.from_bytes(raw[4:8], "little"), len(raw) - raw[0])
        out = decode("lzvn", raw[raw[0] : raw[0] + size], MAX_OUTPUT) if size > 0 else None
        return ("decoded", out) if out else ("plain", raw)
    if head is None:
        return "plain", raw
    codec, payload, size = head
    limit = size if 0 < size <= MAX_OUTPUT and codec != "raw" else MAX_OUTPUT
    out = decode(codec, payload, limit)
    if out and codec != "raw" and len(out) >= MAX_OUTPUT:  # it may go on: what is cut does not stand for the whole
        return "broken", None
    return ("decoded", out) if out else ("broken", None)


def unpack_blobs(blobs: DataFrame, content: str = "content") -> DataFrame:
    """All columns of ``blobs``, and ``how`` and ``decoded`` of the blob; null content is broken."""
    schema = blobs.schema
    at = schema.names.index(content)

    def run(batches):
        for batch in batches:
            found = [("broken", None) if raw is None else unpack_blob(raw) for raw in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=[*schema.names, "how", "decoded"])

    from pyspark.sql.types import BinaryType, StringType, StructType

    out = StructType([*schema.fields]).add("how", StringType()).add("decoded", BinaryType())
    return blobs.mapInArrow(run, out)


def identify_blobs(blobs: DataFrame, content: str = "content", head_bytes: int = 262_144) -> DataFrame:
    """The outcome for each recovered blob: ``noise``, ``unrecoverable``, ``identified`` with an extension, or ``unknown``.

    Of plain blobs the first ``head_bytes`` are classified, as a signature and text patterns stand at the start. Blobs
    that may have a compression header are decoded from their first byte to the last, and noise is judged on the whole
    blob, so ``content`` must be the whole of it. Classification runs in the JVM, Python only decodes blobs.
    """
    from .classify import first_class, from_text_run, is_noise

    packed = F.hex(F.substring(F.col(content), 1, 4)).rlike("^66706D63|^..000000")
    looked = blobs.withColumn("_noise", is_noise(F.col(content))).withColumn("_head", F.when(packed, F.col(content)).otherwise(F.substring(F.col(content), 1, head_bytes)))
    found = unpack_blobs(looked, "_head")
    data = F.col("decoded")
    plain = F.when(F.col("how") == "plain", F.col("_head"))
    ext = first_class(F.array(data, from_text_run(data), *[from_text_run(F.substring(plain, 1 + skip, head_bytes)) for skip in (8, 12, 16)]))
    outcome = F.when(F.col("_noise") | is_noise(data), "noise").when(F.col("how") == "broken", "unrecoverable").when(F.col("extension").isNotNull(), "identified").otherwise("unknown")
    keep = [c for c in blobs.columns if c not in (content, "extension", "outcome")]
    return found.withColumn("extension", F.when(F.col("how") != "broken", ext)).withColumn("outcome", outcome).withColumn("extension", F.when(F.col("outcome") == "identified", F.col("extension"))).select(*keep, "outcome", "extension", "how", "decoded")


def file_content(kind: int, inline: bytes | None, fork: bytes | None, size: int, file_size: int = 0) -> bytes | None:
    """A transparently compressed file: from the attribute (after its 16-byte header), else from the resource fork."""
    want = size or file_size
    codec = CODEC_OF.get(kind)
    if not 0 < want <= FILE_LIMIT or codec in (None, "raw"):
        return None
    if inline and len(inline) > 16 and (out := decode(codec, inline[16:], want)):
        return out
    if fork:
        body = fork[256:] if len(fork) > 256 and fork[:4] == RESOURCE_HEADER else fork
        return decode(codec, body, want)
    return None
