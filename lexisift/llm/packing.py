"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens. Each partition packs its pieces by best-fit decreasing and
computes lower bounds on its number of bins from dual feasible functions. A partition whose count meets its bound is
certified; it keeps its bins but the emptiest, whose documents it offers to others. A partition with a gap offers the documents
of all its bins with free room. What was offered is dealt out anew and packed again, as long as that gains a bin and what is
offered is not certified as a whole; every round saves a bin at least, so it ends. A round that gains nothing is not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.chunk_table import chunks_in_buffer, table_for
from lexisift.llm.common import discard, keyed, map_texts, stash

#: Pieces a task packs at a time.
PIECES_A_TASK = 100_000
#: Distinct chunks that a worker remembers.
TABLE_CHUNKS = 200_000


def tokenised_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; null and empty texts are the end id alone."""

    def step(ids: pa.Array, texts: pa.Array) -> dict:
        flat, starts = table_for("tokenizers", path, TABLE_CHUNKS).encode_distinct(*chunks_in_buffer(texts, spaced=False))
        out: list[tuple[int, int, int, int, int]] = []
        for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
            out += [(row, k, at, len(part := own[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(own), capacity))]
        row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out, strict=True))
        return {"doc_id": ids.take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint", arrow=True)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions: thresholds, which count items over half a bin each in
    a bin of its own, and roundings to multiples of 1/k."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1))


def bound_of(number: np.ndarray) -> int:
    """The same from the number of items of each length from 0 to the capacity."""
    if not number.any():
        return 0
    capacity = len(number) - 1
    size = np.arange(capacity + 1)
    n, s = np.cumsum(number), np.cumsum(number * size)
    best = -(-int(s[-1]) // capacity)
    half = capacity // 2
    a = np.arange(1, half + 1)
    alone = n[capacity] - n[capacity - a]
    large, large_sum = n[capacity - a] - n[half], s[capacity - a] - s[half]
    small = s[half] - s[a - 1]
    best = max(best, int((alone + large + np.maximum(0, -(-(small - (large * capacity - large_sum)) // capacity))).max()))
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; lengths must descend. One bit says for each free room whether a bin has it."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, bins = 0, 0
    out = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fitting = have >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = rooms[room]
            at = own.pop()
            if not own:
                have ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        if left := room - length:
            rooms[left].append(at)
            have |= 1 << left
        out[i] = at
    return out


def _packed(pieces: DataFrame, capacity: int, tasks: int, turn: int) -> DataFrame:
    """Packs each of so many partitions; adds sequence_id, offset, and whether the row is offered to others."""
    names = [*pieces.columns, "sequence_id", "offset", "offered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        if len(fill) == lower_bound(lengths, capacity):
            offered = bins == fill.argmin() if fill.min() < capacity else np.zeros(len(bins), bool)
        else:
            offered = fill[bins] < capacity
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(first, append=len(order)))
        part = (turn << 24) + TaskContext.get().partitionId()
        for batch in pa.table([*table.columns, pa.array((part << 32) + bins), pa.array(offset), pa.array(offered)], names=names).to_batches(max_chunksize=50_000):
            yield batch

    kinds = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return pieces.repartition(tasks).mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint, offered boolean")


def pack(pieces: DataFrame, capacity: int = 4096, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces (with doc_id, piece and length from 1 to capacity; other columns may bear any
    name, those of sequence_id, offset and offered are replaced).

    The driver sees three numbers a round. Repeated rows are packed once each; ties are broken by id and piece; an
    empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset", "offered")
    done: list[DataFrame] = []
    turn = 0
    n = pieces.count()
    now = stash(_packed(pieces, capacity, max(1, -(-n // pieces_a_task)), turn), "packed-0")
    while True:
        turn += 1
        offered = now.filter("offered")
        n, bins, total = offered.agg(F.count("*"), F.count_distinct("sequence_id"), F.sum("length")).first()
        if bins < 2 or -(-total // capacity) == bins:
            break  # what was offered cannot do with fewer
        tasks = -(-n // pieces_a_task)
        again = stash(_packed(offered.drop("sequence_id", "offset", "offered"), capacity, tasks, turn), f"packed-{turn}")
        if again.select("sequence_id").distinct().count() >= bins:
            discard(again)
            break
        done.append(now.filter("not offered"))
        now = again
    out = now
    for x in done:
        out = out.unionByName(x)
    return out.drop("offered")


def certificate(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, the lower bound of all pieces together, and the gap between them, which is 0 where packing is
    certified as the best there is. The driver holds the number of pieces of each length."""
    number = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        number[r.length] = r.n
    bound = bound_of(number)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).alias("bound"), (F.col("sequences") - bound).alias("gap"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of every document in one place.

    Null and empty texts are the end id alone; null ids and rows that share an id are documents of their own; whole texts
    are read and only those over the capacity are cut; other columns are not read. An empty table gives an empty one.
    """
    pieces = stash(tokenised_pieces(docs, path, end_id, capacity, id_col, text_col), "pieces")
    packed = pack(pieces, capacity)
    discard(pieces)
    return packed
