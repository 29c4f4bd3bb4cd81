"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

A fingerprint's 64 bits are cut into six blocks. Two fingerprints that differ in at most three bits agree in at least three
blocks, so they share one of twenty keys of three blocks each, about 32 bits long. Each distinct fingerprint stands once
however many documents have it. Within a key, links are found as a spanning forest, never as all pairs; a key with
more than KEY_ROWS fingerprints is dealt in parts, and every pair of parts is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm import similar
from lexisift.llm.common import discard, keyed, map_texts, row_key, stash, whole_groups, without
from lexisift.llm.components import Trees, close_pairs, components

#: Seed of the hash, bits that may differ, and fingerprints of a key that one task compares.
SEED, DISTANCE, KEY_ROWS = 42, 3, 4096
WIDTHS = (11, 11, 11, 11, 10, 10)
BLOCKS = [((1 << w) - 1) << sum(WIDTHS[:i]) for i, w in enumerate(WIDTHS)]
MASKS = [sum(c) for c in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]
#: Shingles whose bits are counted at a time.
SLAB = 100_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it is so in more than half of the shingles' hashes; no word: 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    width = min(shingle, len(words))
    begins = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), SLAB):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begins[at : at + SLAB], ends[at : at + SLAB], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def step(ids: pa.Array, texts: list[str]) -> dict:
        return {"doc_id": ids, "fp": np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)}

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, fp bigint")


def links(distinct: DataFrame, distance: int = DISTANCE, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints (fp, rep) that connect the same documents
    as all close pairs would."""
    if distance > DISTANCE:
        raise ValueError("the blocks are cut for three bits at most")
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(MASKS)])
    rows = distinct.select("fp", "rep", F.explode(keys).alias("key")).select("fp", "rep", "key.kind", "key.value")
    shared = stash(rows.groupBy("kind", "value").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    rows = rows.join(shared, ["kind", "value"])
    parts = F.ceil(F.col("n") / key_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("kind", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "rep")
    names = ["kind", "value", "p", "q"]
    kind = dict(distinct.dtypes)["rep"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        for table, begins in whole_groups(batches, names):
            reps = table["rep"].combine_chunks()
            i, j = close_pairs(table["fp"].to_numpy().view(np.uint64), begins, distance)
            for a, b in zip(reps.take(pa.array(i)).to_pylist(), reps.take(pa.array(j)).to_pylist(), strict=True):
                trees.join(a, b)
        yield trees.links({"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(kind, pa.string()))

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(link, f"a {kind}, b {kind}")


def classes(marked: DataFrame, id_col: str, distance: int) -> DataFrame:
    """fp2 and component of every fingerprint of marked (id_col, fp): the smallest id reachable by links."""
    distinct = stash(marked.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-distinct")
    found = stash(components(links(distinct.filter("rep IS NOT NULL"), distance)), "simhash-components")
    return stash(distinct.join(found, distinct.rep == found.node, "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "rep").alias("component_id")), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs without ASCII white space, A to Z in lower case. Documents whose fingerprints differ in at most
    ``distance`` bits are linked; component_id is the smallest id reachable. Null and empty texts have
    fingerprint 0, which links like any other. Rows that repeat an id have each a row. A null id names no component:
    a group of such documents alone has a null one. Ids are whole numbers or strings; whole texts are read, however
    long, and other columns are not. An empty table gives an empty one.
    """
    marked = stash(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    found = classes(marked, "doc_id", distance)
    return marked.join(found, F.col("fp") == F.col("fp2"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group (that with the smallest id), with all their columns, which may bear any name.

    With ``similarity`` the groups are those of all documents linked by a Jaccard index of their sets of ``shingle``-word
    shingles of at least so much, which lies far beyond three of 64 bits; they are found by fingerprints of 256 bits and verified
    as in the module ``similar``. A
    document is a row: rows that share an id are judged by their own texts, null ids come last, of rows equal in id
    and text one stays. Null and empty texts are equal to each other. An empty table gives an empty one.
    """
    rows = docs.select(row_key(docs, id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    if similarity is not None:
        found = components(similar.links(keyed(rows, "doc_id", "text"), similarity, shingle))
        gone = found.filter("node != component").select(F.col("node").alias("key")).distinct()
    else:
        marked = stash(fingerprints(rows, shingle), "simhash-fingerprints")
        joined = marked.join(classes(marked, "doc_id", distance), F.col("fp") == F.col("fp2"))
        gone = joined.filter("doc_id != component_id").select(F.col("doc_id").alias("key")).distinct()
    return without(docs, stash(gone, "near-gone", few=True), id_col, text_col)
