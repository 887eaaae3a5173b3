"""Small block images for tests: superblock, tree leaves with any records, data blocks."""

import struct

BS = 4096


def drec(parent, name, file, is_dir=False):
    raw = name.encode() + b"\0"
    return struct.pack("<QI", parent | 9 << 60, len(raw)) + raw, struct.pack("<QQH", file, 0, 4 if is_dir else 8)


def inode(own, parent, mode, size=None, link=None, mtime=1_600_000_000 * 10**9, flags=0):
    val = struct.pack("<QQQQQQ", parent, own, mtime, mtime, mtime, mtime) + bytes(20) + struct.pack("<IIIH", flags, 501, 20, mode) + bytes(10)
    fields = []
    if size is not None:
        fields.append((8, struct.pack("<QQQQQ", size, size, 0, 0, 0)))
    if link is not None:
        fields.append((13, link.encode() + b"\0"))
    val = val[:92]
    if fields:
        val += struct.pack("<HH", len(fields), 0)
        val += b"".join(struct.pack("<BBH", k, 0, len(d)) for k, d in fields)
        val += b"".join(d + bytes(-len(d) % 8) for _, d in fields)
    return struct.pack("<Q", own | 3 << 60), val


def extent(own, logical, physical, length, key=0):
    return struct.pack("<QQ", own | 8 << 60, logical), struct.pack("<QQQ", length, physical, key)


def xattr(own, name, data, flags=2):
    raw = name.encode() + b"\0"
    return struct.pack("<QH", own | 4 << 60, len(raw)) + raw, struct.pack("<HH", flags, len(data)) + data


def leaf(records, xid=5, root=False, fixed=False, bs=BS, break_table=False):
    table = len(records) * (4 if fixed else 8)
    base, end = 56 + table, bs - 40 if root else bs
    keys, values, toc = b"", b"", b""
    for k, v in records:
        values = v + values
        off = len(values)
        toc += struct.pack("<HH", len(keys), off) if fixed else struct.pack("<HHHH", len(keys), len(k), off, len(v))
        keys += k
    if break_table:
        toc = bytes(len(toc))
    head = struct.pack("<QQQII", 0, 1, xid, 2, 0) + struct.pack("<HHIHH", 2 | root | fixed * 4, 0, len(records), 0, table) + bytes(56 - 44)
    block = bytearray(bs)
    block[: len(head)] = head
    block[56 : 56 + table] = toc
    block[base : base + len(keys)] = keys
    block[end - len(values) : end] = values
    return bytes(block)


def superblock(uuid=bytes(16), keylocker=0, bs=BS, blocks=64):
    b = bytearray(bs)
    struct.pack_into("<QQQ", b, 0, 0, 1, 9)
    b[32:36] = b"NXSB"
    struct.pack_into("<IQ", b, 36, bs, blocks)
    b[72:88] = uuid
    struct.pack_into("<QQ", b, 1296, keylocker, 1 if keylocker else 0)
    return bytes(b)


def image(parts, blocks=64, bs=BS):
    """``parts`` maps block numbers to contents."""
    out = bytearray(blocks * bs)
    for n, raw in parts.items():
        out[n * bs : n * bs + len(raw)] = raw
    return bytes(out)
