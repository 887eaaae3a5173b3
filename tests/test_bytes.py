import ctypes
import ctypes.util
import os
import zlib

import numpy as np
import pytest

from gneiss.functions import codecs, crypto


@pytest.mark.parametrize(
    "src, limit, want",
    [
        ("06", 8, b""),
        ("E448454C4C4F06", 32, b"HELLO"),
        ("F002" + "AB" * 18 + "06", 64, b"\xab" * 18),
        ("E5414243414243000306", 32, b"ABCABCABC"),
        ("E258595A00030003000306", 32, b"XYZXYZXYZXYZ"),
        ("E44845", 32, b""),
    ],
)
def test_lzvn(src, limit, want):
    assert codecs.lzvn(bytes.fromhex(src), limit) == want


def test_lzvn_stops_at_the_limit():
    assert len(codecs.lzvn(bytes.fromhex("E448454C4C4F06"), 3)) <= 3
    assert codecs.lzvn(bytes.fromhex("E0410001" * 1 + "500106"), 5) == b"AAAAA"


def test_blob_headers():
    text = b"hello " * 50
    z = zlib.compress(text)
    head = lambda kind, payload, n: b"fpmc" + kind.to_bytes(4, "little") + n.to_bytes(8, "little") + payload
    assert codecs.unpack_blob(head(3, z, len(text))) == ("decoded", text)
    assert codecs.unpack_blob(head(4, z[2:-4], len(text))) == ("decoded", text)  # without zlib's own header
    assert codecs.unpack_blob(head(9, b"as it is", 8)) == ("decoded", b"as it is")
    assert codecs.unpack_blob(head(3, b"broken", 99)) == ("broken", None)
    assert codecs.unpack_blob(head(12, b"bvx2....", 99)) == ("broken", None)
    assert codecs.unpack_blob(b"plain text") == ("plain", b"plain text")
    assert codecs.unpack_blob(bytes([8, 0, 0, 0, 7, 0, 0, 0]) + bytes.fromhex("E448454C4C4F06")) == ("decoded", b"HELLO")
    assert codecs.unpack_blob(b"") == ("plain", b"")
    assert codecs.lzfse(b"bvx-\x03\0\0\0abc", 10) == b"abc"
    assert codecs.lzfse(b"bvxn\x05\0\0\0\x07\0\0\0" + bytes.fromhex("E448454C4C4F06"), 10) == b"HELLO"
    assert codecs.file_content(4, None, b"\0\0\x01\0" + bytes(252) + z, len(text)) == text
    assert codecs.file_content(3, bytes(16) + z, None, len(text)) == text
    assert codecs.file_content(3, None, None, 0) is None


def test_aes_known_answers():
    plain = np.arange(16, dtype=np.uint8).reshape(1, 16) * 17
    for key, want in ((bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        keys = crypto.expand_key(key)
        out = crypto.encrypt_blocks(plain, keys)
        assert out.tobytes().hex() == want
        assert (crypto.decrypt_blocks(out, keys) == plain).all()


def test_xts_known_answer_and_round_trips():
    c = crypto.SectorCipher(bytes(16), bytes(16))
    assert c.encrypt(bytes(512), 0)[:32].hex() == "917cf69ebd68b2ec9b9fe9a3eadda692cd43d2f59598ed858c02c2652fbf922e"
    rng = np.random.default_rng(0)
    for sector in (0, 7, 1 << 40):
        k1, k2, data = rng.bytes(16), rng.bytes(16), rng.bytes(2048)
        c = crypto.SectorCipher(k1, k2)
        enc = c.encrypt(data, sector)
        assert c.decrypt(enc, sector) == data and c.decrypt(enc[512:1024], sector + 1) == data[512:1024]
        assert crypto.SectorCipher(k2, k1).decrypt(enc, sector) != data and c.decrypt(enc, sector + 1) != data


def test_xts_against_the_system_library():
    name = ctypes.util.find_library("crypto") or "libcrypto.so.3"
    try:
        lib = ctypes.CDLL(name)
        lib.EVP_CIPHER_CTX_new.restype = lib.EVP_aes_128_xts.restype = ctypes.c_void_p
    except (OSError, AttributeError):
        pytest.skip("no system library")
    k1, k2, data = bytes(range(16)), bytes(range(16, 32)), os.urandom(512)
    ctx = ctypes.c_void_p(lib.EVP_CIPHER_CTX_new())
    tweak = (7).to_bytes(16, "little")
    assert lib.EVP_EncryptInit_ex(ctx, ctypes.c_void_p(lib.EVP_aes_128_xts()), None, k1 + k2, tweak) == 1
    out, n = ctypes.create_string_buffer(600), ctypes.c_int()
    assert lib.EVP_EncryptUpdate(ctx, out, ctypes.byref(n), data, 512) == 1
    assert crypto.SectorCipher(k1, k2).decrypt(out.raw[:512], 7) == data


def test_key_wrapping():
    kek = bytes.fromhex("000102030405060708090A0B0C0D0E0F")
    key = bytes.fromhex("00112233445566778899AABBCCDDEEFF")
    wrapped = crypto.wrap_key(key, kek)
    assert wrapped.hex().upper() == "1FA68B0A8112B447AEF34BD8FB5A7B829D3E862371D2CFE5"
    assert crypto.unwrap_key(wrapped, kek) == key
    assert crypto.unwrap_key(wrapped[:-1] + b"\0", kek) is None
