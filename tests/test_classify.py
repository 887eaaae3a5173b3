import pytest
from pyspark.sql import functions as F

from gneiss.functions import classify as C

CASES = [
    *[(raw + b"\x10" * 8 if offset == 0 else b"\0\0\0\x20" + raw + b"????", ext) for offset, raw, ext in C.MAGIC if ext not in ("riff", "ftyp", "utf16")],
    *[(b"RIFF\0\0\0\0" + raw, ext) for raw, ext in C.RIFF],
    (b"RIFF\0\0\0\0UNKN", "riff"),
    (b"RIFF", "riff"),
    *[(b"\0\0\0\x20ftyp" + raw, ext) for raw, ext in C.FTYP],
    (b"\0\0\0\x20ftypisom", "mp4"),
    (b"\xff\xfe" + "Hello <html>".encode("utf-16-le"), "html"),
    (b"\xff\xfe" + "Hello there".encode("utf-16-le"), "txt"),
    ("windows registry editor, no mark".encode("utf-16-le"), "reg"),
    ("plain words without any mark at all".encode("utf-16-le"), "txt"),
    *[(b"  " + p.upper().encode() + b"  and so on", e) for p, e in (("<!doctype html", "html"), ("create table", "sql"), ("-----begin certificate-----", "pem"), ("mime-version:", "eml"))],
    (b'{"key": 1}', "json"),
    (b"#! /bin/csh\n", "sh"),
    (b"", None),
    (bytes(64), None),
    (b"A sentence in plain ASCII.", "txt"),
    (b"\x89", None),
    (bytes(range(1, 9)), None),
    ("日本語の文章です。".encode(), "txt"),
    ("naïve café — déjà vu".encode(), "txt"),
    (b"\xc3\x28" * 30, None),
    (b"x" * 300 + b"\x01" * 300 + b"select 1", "txt"),
    (b"\x01\x02" * 240 + b"x" * 24 + b"select ", "sql"),
    (b"\x01\x02" * 252 + b"select ", "sql"),
    (b"\x01\x02" * 253 + b"select ", None),
]


def test_cases(spark):
    rows = [(i, bytearray(raw)) for i, (raw, _) in enumerate(CASES)] + [(-1, None)]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, c binary").select("i", C.classify(F.col("c")).alias("e")).collect()}
    assert got.pop(-1) is None
    assert {i: e for i, e in got.items() if e != CASES[i][1]} == {}


def test_runs_noise_and_names(spark):
    rows = [(1, bytearray(b"\x01\x02" * 50 + b"#!/bin/sh and more")), (2, bytearray(50)), (3, bytearray(b"\xff" * 9)), (4, bytearray(b"")), (5, bytearray(b"\0\xff"))]
    df = spark.createDataFrame(rows, "i int, c binary")
    got = {r.i: (r.at, r.deep, r.noise) for r in df.select("i", C.text_run(F.col("c")).alias("at"), C.classify_deep(F.col("c")).alias("deep"), C.is_noise(F.col("c")).alias("noise")).collect()}
    assert got == {1: (101, "sh", False), 2: (0, None, True), 3: (0, None, True), 4: (0, None, True), 5: (0, None, False)}
    jpg, png = "FFD8FFE0000102030405", "89504E470D0A1A0A0001"
    names = [("a.txt", jpg, "a.jpg"), ("a.JPEG", jpg, "a.JPEG"), ("a.png", jpg, "a.jpg"), ("a", png, "a.png"), ("d.x/.hid", png, "d.x/.hid.png"), ("a.txt", "00", "a.txt")]
    df = spark.createDataFrame([(n, h, w) for n, h, w in names], "n string, h string, w string")
    assert [(r.g, r.w) for r in df.select(C.correct_extension(F.col("n"), F.unhex("h")).alias("g"), "w").collect() if r.g != r.w] == []
    z = df.limit(1).select(C.zip_type(F.lit(b"PK\x03\x04....word/document.xml")).alias("a"), C.zip_type(F.lit(b"PK\x03\x04....")).alias("b")).first()
    assert (z.a, z.b) == ("docx", "zip")


@pytest.mark.parametrize("size", [511, 512])
def test_preview_boundary(spark, size):
    raw = b"\x01" * (size - 6) + b"<html>"
    (r,) = spark.createDataFrame([(bytearray(raw),)], "c binary").select(C.classify(F.col("c")).alias("e")).collect()
    assert r.e == "html"  # the pattern "<html" ends within the preview in both cases
