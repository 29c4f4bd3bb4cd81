"""The form for dictionaries too large to broadcast: windows of the texts and the patterns' first chunks meet in a shuffled join.

Texts pass once through a rolling hash in Arrow batches, level by level: a window of 2^(j+1) characters from two of 2^j. Only
levels that patterns begin with are looked at. A window goes on only if a bitmap of the first chunks' hashes, of at most
GATE_BITS bits whatever the size of the dictionary, has its hash (gating); of equal windows of a text, those whose next
characters up to twice the chunk are equal too are one row with all their places (grouping). So what is shuffled are the places
that may begin a pattern, and patterns are verified on the rows themselves, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.plans.storage import stash

#: Bits of the gate as a power of two: 32 MB.
GATE_BITS = 28
BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + np.uint64(level)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(text: str, levels: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(level, hash of the window of so many characters at each place) for the levels asked for, which are powers of two."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    level, power = 1, BASE
    while level <= len(text):
        if level in levels:
            yield level, _mixed(h, level)
        h = h[:-level] * np.uint64(power) + h[level:] if level < len(h) else h[:0]
        level, power = 2 * level, power * power & (1 << 64) - 1


def _keys(patterns: DataFrame) -> DataFrame:
    """pattern_id, pattern, n, level (the largest power of two up to n) and h, the hash of the first so many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [next(rolling(p[:level], {level}))[1][0] for p, level in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(h, np.uint64).view(np.int64))], names=["pattern_id", "pattern", "n", "level", "h"])

    plain = patterns.filter("pattern IS NOT NULL AND pattern != ''").select(F.col("pattern_id").cast("long"), "pattern", F.length("pattern").alias("n"))
    return plain.withColumn("level", T.bit_floor(F.col("n"))).mapInArrow(run, "pattern_id bigint, pattern string, n int, level int, h bigint")


def gate_of(keys: DataFrame) -> tuple[np.ndarray, set[int]]:
    """A bitmap of the hashes (place: their first GATE_BITS bits) and the levels, at most one for each power of two."""
    bits = np.zeros(1 << GATE_BITS - 3, np.uint8)
    place = F.shiftrightunsigned("h", 64 - GATE_BITS)
    width = min(32_768, 1 << GATE_BITS)
    rows = keys.select(F.floor(place / width).alias("block"), F.pmod(place, F.lit(width)).alias("bit")).groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    for r in rows.toLocalIterator():
        own = np.frombuffer(bytes(r.bitmap), np.uint8)[: width // 8]
        bits[r.block * width // 8 :][: len(own)] = own
    return bits, {r.level for r in keys.select("level").distinct().collect()}


def gated_windows(texts: DataFrame, gate: np.ndarray, levels: set[int]) -> DataFrame:
    """text_id, level, h, shade (the window and up to level - 1 characters more), places (from 1) of the windows that pass."""
    shared = texts.sparkSession.sparkContext.broadcast((gate, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = shared.value
        for batch in batches:
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows: dict[tuple[int, int, str], list[int]] = {}
                for level, h in rolling(text, wanted):
                    place = h >> np.uint64(64 - GATE_BITS)
                    open_ = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    for i, own in zip(open_.tolist(), h[open_].view(np.int64).tolist(), strict=True):
                        rows.setdefault((level, own, text[i : i + 2 * level - 1]), []).append(i + 1)
                if rows:
                    level, h, shade = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([text_id] * len(rows), pa.int64()), pa.array(level, pa.int32()), pa.array(h, pa.int64()), pa.array(shade, pa.string()), pa.array(rows.values(), pa.list_(pa.int32()))], names=["text_id", "level", "h", "shade", "places"])

    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(run, "text_id bigint, level int, h bigint, shade string, places array<int>")


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, n (length of the pattern), places: for each shade that begins with the pattern where it stands."""
    keys = stash(_keys(patterns), "window-keys")
    found = gated_windows(texts, *gate_of(keys)).join(keys, ["level", "h"])
    return found.filter(F.expr("substring(shade, 1, n)") == F.col("pattern")).select("text_id", "pattern_id", "n", "places")
