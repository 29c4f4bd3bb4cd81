"""Which form a dictionary search takes.

``automaton``: the dictionary is broadcast and every text passes once through a multi-pattern automaton in Arrow batches.
``windows``: for dictionaries too large to broadcast; windows of the texts and keys of the patterns meet in a shuffled join.
``native``: the dictionary is broadcast and blocks of the texts are looked up in it by hashes, without Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a dictionary that may be broadcast. An automaton takes about 50 bytes a character in every Python worker.
BROADCAST_CHARS = 2 << 20


def size(patterns: DataFrame) -> int:
    """Characters of patterns (pattern), with some more for each."""
    return patterns.agg(F.sum(F.coalesce(F.length("pattern"), F.lit(0)) + 16)).first()[0] or 0


def choose(patterns: DataFrame) -> str:
    """By the measured size of patterns (pattern)."""
    return "automaton" if size(patterns) <= BROADCAST_CHARS else "windows"


def check(patterns: DataFrame) -> None:
    """An error if patterns are too large to broadcast."""
    if (n := size(patterns)) > BROADCAST_CHARS:
        raise ValueError(f"a dictionary of {n} characters is too large to broadcast, {BROADCAST_CHARS} at most")


def slices(patterns: DataFrame) -> list[DataFrame]:
    """patterns as dictionaries of which each may be broadcast, by the hash of the pattern."""
    parts = -(-2 * size(patterns) // BROADCAST_CHARS)  # twice as many, since slices differ in size
    return [patterns] if parts <= 2 else [patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k) for k in range(parts)]
