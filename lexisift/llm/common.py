"""What the operators share: the shared folder, written tables, Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.plans.storage import discard, new_path, shared_dir, stash

__all__ = ["discard", "new_path", "shared_dir", "stash"]

#: Bytes of text that one step of an Arrow operator holds as Python strings.
STEP_BYTES = 8 << 20
#: ASCII white space, the only separators of words in these operators.
WORD = r"[^\x20\x09-\x0D]+"
#: The same as one string, for translate().
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A binary key of id and text, so that rows that share an id are told apart. Keys ascend as ids do, null ids are
    the last, whole numbers in their own order and all other ids in that of their text."""
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    number = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if whole else F.concat(F.hex(F.col(id_col).cast("string")), F.lit("00"))
    text = F.lpad(F.hex(F.xxhash64(text_of(text_col))), 16, "0")
    return F.unhex(F.concat(F.when(F.col(id_col).isNull(), "01").otherwise(F.concat(F.lit("00"), number)), text))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose key is not in gone (key), with all their columns. Of rows that repeat a key one stays."""
    rows = docs.select(F.struct("*").alias("row"), row_key(docs, id_col, text_col).alias("key"))
    repeated = stash(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys-repeated", few=True)
    rows = rows.join(gone, "key", "left_anti")
    once = rows.join(repeated, "key", "left_anti")
    return once.unionByName(rows.join(repeated, "key", "left_semi").dropDuplicates(["key"])).select("row.*")


def give_back() -> None:
    """Returns freed memory to the system, since a Python worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], text: int | str = 1, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most step_bytes in the column of texts each, or of one document if that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > step_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size)
        if begin < len(sizes):
            yield batch.slice(begin)


def slices(batches: Iterator[pa.RecordBatch], step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of at most step_bytes of text each, or of one document if that is longer."""
    for batch in parts(batches, 1, step_bytes):
        yield batch.column(0), batch.column(1)


def steps(batches: Iterator[pa.RecordBatch], step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """The same with texts as Python strings."""
    for ids, texts in slices(batches, step_bytes):
        yield ids, texts.to_pylist()


def map_texts(
    docs: DataFrame, step: Callable[..., dict], schema: str, names: list[str] | None = None, arrow: bool = False, text: Callable[[pa.Array], pa.Array] | None = None
) -> DataFrame:
    """Applies step to (doc_id, text) in bounded steps; step returns the columns of schema. names: those of the
    columns, where a type of the schema has commas; arrow: step takes texts as an Arrow array; text: finds the texts in the
    first column, where there is no second."""
    names = names or [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if text:
            batches = (pa.RecordBatch.from_arrays([b.column(0), text(b.column(0))], names=["doc_id", "text"]) for b in batches)
        gc.disable()  # steps make no cycles, and the collector would visit their many strings again and again
        try:
            for ids, texts in slices(batches) if arrow else steps(batches):
                columns = step(ids, texts)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)], names=names)
        finally:
            gc.enable()
            give_back()

    return docs.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups of rows sorted by keys, and where each group begins (one more for the end)."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            own = table[k].to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = held[-1] if held else None
        held.append(batch)
        if last is not None and all(last.column(k)[-1] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue  # the same group goes on
        table = pa.Table.from_batches(held).combine_chunks()
        first = begins(table)
        if len(first) > 1:
            yield table.slice(0, int(first[-1])), first
        held = table.slice(int(first[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(begins(table), table.num_rows)
