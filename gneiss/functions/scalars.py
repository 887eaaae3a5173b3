"""Scalar functions as Spark columns: paths, formatting, bit fields, times, modes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0o170000, 0o100000, 0o040000, 0o120000
#: How far ahead of "now" a time stamp may lie, in seconds.
FUTURE_SECONDS = 732 * 86_400
#: 1990-01-01 in seconds.
EARLIEST_CREATION = 631_152_000


def sanitize_path(path: Column) -> Column:
    """A relative path without control characters and without empty, ``.`` and ``..`` parts."""
    parts = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, r"[\x00-\x1f\x7f]", ""))
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def last_extension(name: Column) -> Column:
    """What follows the last dot of the last path part, in lower case; empty where there is no dot."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def suffix_before_extension(path: Column, suffix: Column | str) -> Column:
    """``a/b.txt`` with ``_X`` becomes ``a/b_X.txt``; names without an extension, dot files included, get it at the end."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    stem = F.regexp_extract(path, r"^(.*[^/])(\.[^./]*)$", 1)
    return F.when(stem == "", F.concat(path, suffix)).otherwise(F.concat(stem, suffix, F.regexp_extract(path, r"^(.*[^/])(\.[^./]*)$", 2)))


def format_count(n: Column) -> Column:
    """Thousands separators from 100,000 on."""
    return F.when(n < 100_000, n.cast("string")).otherwise(F.format_number(n, 0))


def format_size(n: Column) -> Column:
    """Binary units with two decimals, plain bytes below one KiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        scaled = F.round(n.cast("double") / float(1024**power), 2).cast("decimal(20,2)").cast("string")
        out = F.when(n >= 1024**power, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``45s``, ``3m 05s``, ``1h 5m`` or ``2d 3h``."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    part = lambda unit, each: F.floor(s / unit) if each is None else F.floor(s / unit) % each
    text = lambda c: c.cast("long").cast("string")
    return (
        F.when(s < 60, F.concat(text(s), F.lit("s")))
        .when(s < 3600, F.concat(text(part(60, None)), F.lit("m "), F.lpad(text(s % 60), 2, "0"), F.lit("s")))
        .when(s < 86_400, F.concat(text(part(3600, None)), F.lit("h "), text(part(60, 60)), F.lit("m")))
        .otherwise(F.concat(text(part(86_400, None)), F.lit("d "), text(part(3600, 24)), F.lit("h")))
    )


def parse_size(text: Column) -> Column:
    """``1.5G`` as bytes; the first letter after the number counts, no letter or an unknown one means bytes; no number gives 0."""
    number = F.regexp_extract(text, r"^\s*([0-9]*\.?[0-9]+)", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9]*\.?[0-9]+\s*([A-Za-z])", 1))
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.when(number == "", F.lit(0).cast("long")).otherwise((number.cast("double") * scale).cast("long"))


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def align_up(n: Column, to: int) -> Column:
    """The next multiple of a power of two."""
    return (n + F.lit(to - 1)).bitwiseAND(F.lit(-to).cast("long"))


def ceil_div(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by).cast("long")


def key_type(key: Column) -> Column:
    """The record type in bits 60 to 63 of a 64-bit key."""
    return F.shiftrightunsigned(key, 60).bitwiseAND(F.lit(15).cast("long"))


def key_id(key: Column) -> Column:
    """The object id in the low 60 bits of a key."""
    return key.bitwiseAND(F.lit((1 << 60) - 1))


def extent_length(field: Column) -> Column:
    return field.bitwiseAND(F.lit((1 << 56) - 1))


def extent_flags(field: Column) -> Column:
    return F.shiftrightunsigned(field, 56).cast("int")


def is_dir_mode(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(S_IFMT)) == S_IFDIR


def is_link_mode(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(S_IFMT)) == S_IFLNK


def safe_mode(mode: Column, is_dir: Column) -> Column:
    """Permission bits to restore: no set-id bits, always open to the owner; 0 means leave as it is."""
    bits = mode.bitwiseAND(F.lit(0o7777)).bitwiseAND(F.lit(0o7777 & ~0o6000))
    return F.when(mode.bitwiseAND(F.lit(0o7777)) == 0, F.lit(0)).otherwise(bits.bitwiseOR(F.when(is_dir, F.lit(0o700)).otherwise(F.lit(0o600))))


def octal(mode: Column) -> Column:
    return F.conv(mode.cast("string"), 10, 8)


def ns_seconds(ns: Column) -> Column:
    return _div(ns, 1_000_000_000)


def ns_rest(ns: Column) -> Column:
    return F.pmod(ns, F.lit(1_000_000_000).cast("long"))


def _div(n: Column, by: int) -> Column:
    return ((n - F.pmod(n, F.lit(by).cast("long"))) / F.lit(by)).cast("long")


def valid_time(ns: Column, now_seconds: Column | int) -> Column:
    """Whether a signed nanosecond time is positive and not too far in the future."""
    now = F.lit(now_seconds).cast("long") if isinstance(now_seconds, int) else now_seconds
    return (ns > 0) & (ns_seconds(ns) <= now + FUTURE_SECONDS)


def creation_time(create_ns: Column, modified_ns: Column, now_seconds: Column | int) -> Column:
    """Seconds of the creation time if plausible, else of the modification time, else now."""
    now = F.lit(now_seconds).cast("long") if isinstance(now_seconds, int) else now_seconds
    first = F.when(valid_time(create_ns, now) & (ns_seconds(create_ns) >= EARLIEST_CREATION), ns_seconds(create_ns))
    return F.coalesce(first, F.when(valid_time(modified_ns, now), ns_seconds(modified_ns)), now)


def format_uuid(raw: Column) -> Column:
    """16 bytes as the usual hexadecimal groups, in upper case."""
    h = F.hex(raw)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
