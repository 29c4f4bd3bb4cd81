"""Distinct substrings of texts, in total and by length, from a suffix array and its common prefixes.

The suffix array is built by prefix doubling in numpy, one text at a time in Arrow batches; the ranks of every
doubling give the longest common prefixes of neighbours by descent. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_prefixes(text: str) -> np.ndarray:
    """The longest common prefix of each suffix but the first with the one before it, in sorted order."""
    n = len(text)
    if n < 2:
        return np.zeros(0, np.int64)
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while width < n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank = new
        ranks.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        open_ = np.flatnonzero((a + step <= n) & (b + step <= n))
        same = open_[ranks[level][np.minimum(a[open_], n - 1)] == ranks[level][np.minimum(b[open_], n - 1)]]
        same = same[(a[same] < n) & (b[same] < n)]
        lcp[same] += step
        a[same] += step
        b[same] += step
    return lcp


def by_length(text: str) -> np.ndarray:
    """Distinct substrings of length 1, 2, .., n."""
    n = len(text)
    shared = np.bincount(common_prefixes(text), minlength=n + 1)
    at_least = np.cumsum(shared[::-1])[::-1]  # pairs with so long a common prefix
    length = np.arange(1, n + 1)
    return n - length + 1 - at_least[1 : n + 1]


def _texts(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("text_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def distinct_total(texts: DataFrame) -> DataFrame:
    """text_id, n_distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                n = len(t := t.as_py())
                found.append(n * (n + 1) // 2 - int(common_prefixes(t).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["text_id", "n_distinct"])

    return _texts(texts).mapInArrow(run, "text_id bigint, n_distinct bigint")


def distinct_by_length(texts: DataFrame) -> DataFrame:
    """text_id, len, cnt for every length from 1 to that of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cnt = by_length(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([text_id] * len(cnt), pa.int64()), pa.array(np.arange(1, len(cnt) + 1), pa.int32()), pa.array(cnt, pa.int64())], names=["text_id", "len", "cnt"])

    return _texts(texts).mapInArrow(run, "text_id bigint, len int, cnt bigint")
