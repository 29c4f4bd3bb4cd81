"""Column expressions on strings: normalising, power-of-two chains of lengths, run-length strings. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\r\x0b\x0c"


def normalize(text: Column) -> Column:
    """Letters only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def ascii_lower(text: Column) -> Column:
    """Lowers A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def to_latin(text: Column) -> Column:
    """Characters beyond code point 255 become that of 255."""
    return F.regexp_replace(text, r"[^\x{0}-\x{FF}]", "ÿ")


def strip_line(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Runs without ASCII white space, as an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def token_chunks(text: Column, size: int = 10) -> Column:
    """Every ``size`` words joined by blanks, as an array; the last may have fewer."""
    all_words = words(text)
    n = F.ceil(F.size(all_words) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.concat_ws(" ", F.slice(all_words, k * size + 1, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def chunks(text: Column, size: int = 100) -> Column:
    """Consecutive pieces of ``size`` characters, as an array; the last may be shorter, the empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(text, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def bit_floor(n: Column) -> Column:
    """The largest power of two up to n; 0 for 0."""
    return F.when(n > 0, F.pow(F.lit(2), F.length(F.bin(n)) - 1)).otherwise(0).cast("int")


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def chain(n: Column) -> Column:
    """Lengths and offsets (from 0) of the descending powers of two that make up n, as an array of structs."""
    links = F.filter(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftright", n, b) % 2 == 1)
    return F.transform(links, lambda b: F.struct((F.floor(n / F.pow(F.lit(2), b + 1)) * F.pow(F.lit(2), b + 1)).cast("int").alias("off"), F.pow(F.lit(2), b).cast("int").alias("len")))


def window_hash(text: Column, begin: Column, length: Column) -> Column:
    """Hash of a window with its length, for joins; always verified by comparing texts."""
    return F.xxhash64(length, F.substring(text, begin, length))


def filler_share(text: Column) -> Column:
    """Number of blanks, hyphens and points."""
    return F.length(text) - F.length(F.translate(text, " -.", ""))


def rle_runs(text: Column) -> Column:
    """Runs of a string like 8a4b2c (a missing number is 1) as an array of (n, ch)."""
    found = F.regexp_extract_all(text, F.lit(r"(\d*\D)"), F.lit(1))
    return F.transform(found, lambda r: F.struct(F.when(F.length(r) > 1, F.substring(r, F.lit(1), F.length(r) - 1).cast("int")).otherwise(1).alias("n"), F.right(r, F.lit(1)).alias("ch")))


def rle_decode(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.repeat(r["ch"], r["n"])), "")


def rle_encode(text: Column) -> Column:
    """A text without digits as runs; the inverse of rle_runs and rle_decode."""
    found = F.regexp_extract_all(text, F.lit(r"((?s)(.)\2*)"), F.lit(1))
    return F.array_join(F.transform(found, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")
