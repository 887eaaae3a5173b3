"""Content classification by signature, text pattern and byte statistics, inside the JVM.

Bytes are looked at through ISO-8859-1, in which each byte is one character, so regular expressions count bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Signatures as (offset, bytes, extension), in the order in which they are tried.
MAGIC: list[tuple[int, bytes, str]] = [
    (0, b"\xff\xd8\xff", "jpg"),
    (0, b"\x89PNG\r\n\x1a\n", "png"),
    (0, b"GIF87a", "gif"),
    (0, b"GIF89a", "gif"),
    (0, b"%PDF", "pdf"),
    (0, b"PK\x03\x04", "zip"),
    (0, b"PK\x05\x06", "zip"),
    (0, b"Rar!\x1a\x07", "rar"),
    (0, b"\x1f\x8b", "gz"),
    (0, b"BZh", "bz2"),
    (0, b"\xfd7zXZ\x00", "xz"),
    (0, b"7z\xbc\xaf\x27\x1c", "7z"),
    (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "doc"),
    (0, b"SQLite format 3", "sqlite"),
    (0, b"bplist00", "plist"),
    (0, b"bplist15", "plist"),
    (0, b"bplist16", "plist"),
    (0, b"\xca\xfe\xba\xbe", "macho"),
    (0, b"\xce\xfa\xed\xfe", "macho"),
    (0, b"\xcf\xfa\xed\xfe", "macho"),
    (0, b"\x7fELF", "elf"),
    (0, b"RIFF", "riff"),
    (0, b"OggS", "ogg"),
    (0, b"fLaC", "flac"),
    (0, b"ID3", "mp3"),
    (0, b"\xff\xfb", "mp3"),
    (0, b"\xff\xf3", "mp3"),
    (0, b"\x1a\x45\xdf\xa3", "mkv"),
    (0, b"\x00\x01\x00\x00", "ttf"),
    (0, b"OTTO", "otf"),
    (0, b"wOFF", "woff"),
    (0, b"wOF2", "woff2"),
    (0, b"II\x2a\x00", "tiff"),
    (0, b"MM\x00\x2a", "tiff"),
    (0, b"BM", "bmp"),
    (0, b"\x00\x00\x01\x00", "ico"),
    (0, b"8BPS", "psd"),
    (0, b"koly", "dmg"),
    (0, b"{\\rtf", "rtf"),
    (0, b"\xff\xfe", "utf16"),
    (0, b"\xfe\xff", "utf16"),
    (4, b"ftyp", "ftyp"),
]
# What refines "riff" (at byte 8), "ftyp" (at byte 8) and "zip" (anywhere in the first 512 bytes).
RIFF: list[tuple[bytes, str]] = [(b"WAVE", "wav"), (b"AVI ", "avi"), (b"WEBP", "webp")]
FTYP: list[tuple[bytes, str]] = [(b"heic", "heic"), (b"heis", "heic"), (b"mif1", "heif"), (b"msf1", "heif"), (b"M4A ", "m4a"), (b"M4V ", "m4v"), (b"qt  ", "mov")]
ZIP: list[tuple[bytes, str]] = [(b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"), (b"META-INF/", "jar"), (b"AndroidManifest", "apk")]
# Patterns in lower case and their extension, in the order in which they are tried.
TEXT: list[tuple[str, str]] = [
    ("<!doctype html", "html"),
    ("<html", "html"),
    ("<?xml", "xml"),
    ("<plist", "plist"),
    ("%!ps-adobe", "ps"),
    ("\\begin{document}", "tex"),
    ("\\documentclass", "tex"),
    ("#!/bin/bash", "sh"),
    ("#!/bin/sh", "sh"),
    ("#! /bin/", "sh"),
    ("#!/usr/bin/env bash", "sh"),
    ("#!/usr/bin/env sh", "sh"),
    ("#!/usr/bin/perl", "pl"),
    ("#!/usr/bin/env perl", "pl"),
    ("#!/usr/bin/ruby", "rb"),
    ("#!/usr/bin/env ruby", "rb"),
    ("#!/usr/bin/env python", "py"),
    ("#!/usr/bin/python", "py"),
    ("# -*- coding", "py"),
    ("import sys\n", "py"),
    ("import os\n", "py"),
    ("import re\n", "py"),
    ("using system;", "cs"),
    ("using system.", "cs"),
    ("// <autogenerated>", "cs"),
    ("// <auto-generated>", "cs"),
    ("namespace ", "cs"),
    ("import java.", "java"),
    ("import android.", "java"),
    ("public class ", "java"),
    ("@interface ", "m"),
    ("@implementation ", "m"),
    ("#import <foundation", "m"),
    ("import foundation", "swift"),
    ("import uikit", "swift"),
    ("@charset ", "css"),
    ("/* html elements */", "css"),
    ("body {", "css"),
    ("body{", "css"),
    ("@import ", "css"),
    ("select ", "sql"),
    ("create table", "sql"),
    ("insert into", "sql"),
    ("drop table", "sql"),
    ("-----begin certificate-----", "pem"),
    ("-----begin rsa private key-----", "pem"),
    ("-----begin private key-----", "pem"),
    ("-----begin public key-----", "pem"),
    ("windows registry editor", "reg"),
    ("[hkey_", "reg"),
    ("mime-version:", "eml"),
    ("return-path:", "eml"),
    ("content-type: text/", "eml"),
    ("microsoft visual studio solution", "sln"),
    ("{\"", "json"),
    ("'use strict'", "js"),
    ("module.exports", "js"),
    ("public interface ", "java"),
    ("[assembly:", "cs"),
    ("[general]\n", "ini"),
    ("[general]\r\n", "ini"),
    ("[settings]\n", "ini"),
    ("[interntshortcut]", "url"),
    ("network working group", "txt"),
    ("metadata-version:", "txt"),
]
# How many bytes are looked at, and the shares in percent that make a text.
PREVIEW, WIDE_PREVIEW, SAMPLE, WIDE_SAMPLE = 511, 255, 256, 64
ASCII_PERCENT, GOOD_PERCENT, BAD_PERCENT, WIDE_NULLS, WIDE_PRINTABLE, RUN = 85, 60, 10, 70, 40, 12

PRINTABLE = r"[\x09-\x0d\x20-\x7e]"
SEQUENCE = r"[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}"


def latin(content: Column, start: int, size: int) -> Column:
    """Bytes ``start`` (from 1) and after, one character for each."""
    return F.decode(F.substring(content, start, size), "ISO-8859-1")


def _first(view: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    out = None
    for pattern, ext in rules:
        hit = F.contains(view, F.lit(pattern))
        out = F.when(hit, F.lit(ext)) if out is None else out.when(hit, F.lit(ext))
    return out.otherwise(other)


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def riff_type(content: Column) -> Column:
    tag = F.hex(F.substring(content, 9, 4))
    out = F.lit("riff")
    for raw, ext in reversed(RIFF):
        out = F.when(tag == raw.hex().upper(), ext).otherwise(out)
    return out


def ftyp_type(content: Column) -> Column:
    tag = F.hex(F.substring(content, 9, 4))
    out = F.lit("mp4")
    for raw, ext in reversed(FTYP):
        out = F.when(tag == raw.hex().upper(), ext).otherwise(out)
    return out


def zip_type(content: Column) -> Column:
    """The document or package kind of a zip archive, by the names of its first entries."""
    view = latin(content, 1, 512)
    return _first(view, [(raw.decode("ascii"), ext) for raw, ext in ZIP], F.lit("zip"))


def looks_wide(content: Column) -> Column:
    """UTF-16 little endian: a byte-order mark, or mostly pairs of a printable byte and a zero in the first bytes."""
    view = latin(content, 1, WIDE_SAMPLE)
    pairs = F.floor(F.length(view) / 2)
    nulls = F.length(F.regexp_replace(view, r"(?s).(\x00)|..", "$1"))
    printable = F.length(F.regexp_replace(view, r"(?s)([\x20-\x7e]).|..", "$1"))
    # an odd last byte stays in both replacements; it is an even place, so it counts as printable only
    odd = F.length(view) % 2
    last_printable = F.when((odd == 1) & F.substring(view, -1, 1).rlike(r"[\x20-\x7e]"), 1).otherwise(0)
    guess = (F.floor((nulls - odd) * 100 / pairs) > WIDE_NULLS) & (F.floor((printable - odd + last_printable) * 100 / pairs) > WIDE_PRINTABLE)
    return (F.length(content) >= 16) & (F.startswith(F.hex(F.substring(content, 1, 2)), F.lit("FFFE")) | guess)


def wide_preview(content: Column) -> Column:
    """Every other byte of a UTF-16 text, without its highest bit."""
    marked = F.hex(F.substring(content, 1, 2)) == "FFFE"
    view = F.when(marked, latin(content, 3, 2 * WIDE_PREVIEW)).otherwise(latin(content, 1, 2 * WIDE_PREVIEW))
    half = F.regexp_replace(F.substring(view, 1, 2 * WIDE_PREVIEW), r"(?s)(.).", "$1")
    even = F.substring(half, 1, F.least(F.lit(WIDE_PREVIEW), F.floor(F.length(view) / 2)).cast("int"))
    return F.translate(even, "".join(map(chr, range(128, 256))), "".join(chr(c & 0x7F) for c in range(128, 256)))


def ascii_percent(view: Column) -> Column:
    """The share of printable ASCII characters, as a whole percentage."""
    return F.floor(F.length(F.regexp_replace(view, r"[^\x09-\x0d\x20-\x7e]", "")) * 100 / F.length(view)).cast("long")


def invalid_bytes(view: Column) -> Column:
    """How many bytes are neither printable ASCII nor part of a UTF-8 sequence."""
    return F.length(F.regexp_replace(view, SEQUENCE, "")).cast("long")


def looks_utf8(view: Column) -> Column:
    bad, size = invalid_bytes(view), F.length(view)
    return (size > 0) & (F.floor((size - bad) * 100 / size) >= GOOD_PERCENT) & (F.floor(bad * 100 / size) < BAD_PERCENT)


def classify(content: Column) -> Column:
    """The extension that fits the content, or null: signatures, UTF-16, text patterns, ASCII share, UTF-8."""
    head = F.hex(F.substring(content, 1, 16))
    wide = once(F.lower(wide_preview(content)), lambda v: _first(v, TEXT, F.lit("txt")))
    view = latin(content, 1, SAMPLE)
    plain = once(view, lambda v: F.when(ascii_percent(v) >= ASCII_PERCENT, "txt").when(looks_utf8(v), "txt"))
    text = F.coalesce(once(F.lower(latin(content, 1, PREVIEW)), lambda v: _first(v, TEXT, F.lit(None).cast("string"))), plain)
    refined = {"riff": riff_type(content), "ftyp": ftyp_type(content), "utf16": wide}
    out = F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for offset, raw, ext in MAGIC:
        hit = F.startswith(head, F.lit(raw.hex().upper())) if offset == 0 else F.substring(head, 2 * offset + 1, 2 * len(raw)) == raw.hex().upper()
        out = out.when(hit, refined.get(ext, F.lit(ext)))
    return out.when(looks_wide(content), wide).otherwise(text)


def text_run(content: Column, within: int = 256) -> Column:
    """Where the first run of printable characters starts in the first bytes (from 1), 0 if there is none."""
    return F.regexp_instr(latin(content, 1, within), F.lit(f"{PRINTABLE}{{{RUN},}}"))


def first_class(views: Column) -> Column:
    """The class of the first of several byte strings (an array) that has one; null strings have none."""
    return F.get(F.filter(F.transform(views, classify), lambda c: c.isNotNull()), F.lit(0))


def from_text_run(content: Column) -> Column:
    """What starts at the first text run; null if there is none."""
    return once(content, lambda c: F.when(text_run(c) > 0, F.substring(c, text_run(c), F.length(c))))


def classify_deep(content: Column) -> Column:
    """``classify``, then the same for what starts at the first text run."""
    return first_class(F.array(content, from_text_run(content)))


def is_noise(content: Column) -> Column:
    """Nothing but zeros, or nothing but ones, or nothing at all."""
    return F.hex(content).rlike("^((00)*|(FF)*)$")


def correct_extension(name: Column, content: Column) -> Column:
    """The name, with the extension that a JPEG or PNG signature asks for."""
    found = F.when(F.length(content) > 8, F.when(F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("FFD8FF")), "jpg").when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", "png"))
    own = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    fits = (own == found) | ((found == "jpg") & (own == "jpeg"))
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
    return F.when(found.isNull() | fits, name).otherwise(F.concat(stem, F.lit("."), found))
