"""Links of close fingerprints, and connected components of a graph given as links, by alternating stars; no task and no
driver holds the graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import discard, stash


def close_pairs(fps: np.ndarray, begins: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints (a word each, or a row of words each) in groups, as positions. Small groups are compared at
    each distance of positions at once; in a larger one each member reached takes its neighbours out of those not yet reached."""
    fps = fps.reshape(len(fps), -1)

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= distance

    sizes = np.diff(begins)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sizes <= 32
    end_of = np.repeat(begins[1:], sizes)
    own = np.flatnonzero(np.repeat(small, sizes))
    step = 1
    while len(own := own[own + step < end_of[own]]):
        hit = own[close(fps[own], fps[own + step])]
        left.append(hit)
        right.append(hit + step)
        step += 1
    for g in np.flatnonzero(~small):
        pool = np.arange(begins[g], begins[g + 1])
        while len(pool):
            reached, pool = [int(pool[0])], pool[1:]
            while reached and len(pool):
                at = reached.pop()
                near = close(fps[pool], fps[at])
                hits = pool[near]
                left.append(np.full(len(hits), at))
                right.append(hits)
                reached += hits.tolist()
                pool = pool[~near]
    return np.concatenate(left), np.concatenate(right)


class Trees:
    """Links that a task has found, as trees whose root is the least member."""

    def __init__(self) -> None:
        self.root: dict = {}

    def find(self, x):
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[up]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def links(self, kind: pa.DataType) -> pa.RecordBatch:
        nodes = [x for x, up in self.root.items() if x != up]
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes, kind), "b": pa.array(map(self.find, nodes), kind)})


def _least(links: DataFrame) -> DataFrame:
    """Adds to links (a, b) the least b of each a; the groups are combined before they are shuffled."""
    return links.join(links.groupBy("a").agg(F.min("b").alias("least")), "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).withColumn("least", F.least("least", "a")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    found = _least(links)
    return found.select("a", F.col("least").alias("b")).union(found.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the least node that it reaches.

    Links may repeat, point either way or to themselves. The number of rounds grows with the logarithm of the
    longest path; after each, the links are written to the shared folder.
    """
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = stash(start, "links", few=True)
    state = None
    while True:
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
        large = stash(_large_star(now), "links", few=True)
        small = stash(_small_star(large), "links", few=True)
        discard(now, large)
        now = small
    # every link now goes from a node to the least of its component
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
