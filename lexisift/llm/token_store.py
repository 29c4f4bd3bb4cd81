"""Token ids in files: frequency-ranked ids, byte-aligned, with the control bytes apart from the data bytes.

A file holds blocks. Block layout, all little-endian:

    4 bytes   b"LXV1"
    u32       documents d
    u64       ids n
    u64       ids before this block in its shard
    d x i64   document ids
    d x u8    1 where the document id is null
    d x u32   ids of each document
    n+3 / 4   control bytes: four lengths less one of two bits each, lowest bits first
    rest      data bytes: every rank in 1 to 4 bytes

A rank is the place of an id when ids are ordered by descending frequency over all documents, then by id. A store is a
folder with two Parquet tables and needs nothing else to be read: ``ranks`` (rank, id, n: how often the id stands in
the store) and ``blocks`` (shard, block, n_ids, payload: the bytes above). Documents ascend by id from shard to shard,
from block to block and within each. Blocks are rows of a table, so that a lost executor's half-written files never become
part of it. Texts are tokenised where they are read; only their ids are shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm.chunk_table import chunks_in_buffer, table_for
from lexisift.llm.common import discard, give_back, keyed, map_texts, slices, stash

MAGIC, HEAD = b"LXV1", struct.Struct("<4sIQQ")
#: Bytes of raw ids in a block, or one document if that is longer; ids of a shard, beyond which there are more shards.
BLOCK_BYTES, SHARD_IDS = 4 << 20, 32 << 20
#: For each control byte: its four lengths, where each value begins, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)
BEGINS = (np.cumsum(LENGTHS, axis=1) - LENGTHS).astype(np.int32)
TOTAL = LENGTHS.sum(axis=1).astype(np.int32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    extra = padded[: len(values)]
    for edge in (0xFF, 0xFFFF, 0xFFFFFF):
        more = values > edge
        if not more.any():
            break
        extra += more
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    place = np.int32 if len(values) < 1 << 29 else np.int64
    end = np.cumsum(extra, dtype=place)
    begin = np.arange(len(values), dtype=place) + end - extra
    data = np.empty(len(values) + int(end[-1]) if len(values) else 0, np.uint8)
    raw = values.view(np.uint8)
    data[begin] = raw[0::4]
    for k in range(1, 1 + int(extra.max(initial=0))):
        more = np.flatnonzero(extra >= k)
        data[begin[more] + k] = raw[4 * more + k]
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values, by table lookup of every control byte."""
    total = TOTAL[control]
    begin = (np.cumsum(total, dtype=np.int32 if n < 1 << 29 else np.int64) - total)[:, None] + BEGINS[control]
    begin, length = begin.ravel()[:n], LENGTHS[control].ravel()[:n]
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[begin].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= data[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: pa.Array, lengths: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    control, data = encode_values(ranks)
    none = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    return b"".join([HEAD.pack(MAGIC, len(ids), len(ranks), before), ids.tobytes(), none.tobytes(), lengths.astype("<u4").tobytes(), control, data])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, which of them are null, ids of each, ranks, ids before."""
    magic, d, n, before = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    ids = np.frombuffer(block, "<i8", d, at)
    none = np.frombuffer(block, np.uint8, d, at + 8 * d).astype(bool)
    lengths = np.frombuffer(block, "<u4", d, at + 9 * d)
    at += 13 * d
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    return ids, none, lengths, decode_values(control, np.frombuffer(block, np.uint8, offset=at + len(control)), n), before


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenises documents, each with the end id behind it, and writes the store below path, which must not exist; returns path.

    Ids are whole numbers (others are an error of the cast). Null and empty texts are the end id alone, whole texts are
    read however long; null document ids come first; rows that share an id stand side by side in the order of their
    ids' bytes, so equal rows only can change places. Other columns are not read. An empty table gives a store without blocks. The
    driver holds the frequency of each id, at most as many as the tokenizer has.
    """
    plain = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    narrow = max(table_for("tokenizers", tokenizer).last_id, end_id) <= 0xFFFF
    kind = "<u2" if narrow else "<u4"

    def tokenise(ids: pa.Array, texts: pa.Array) -> dict:
        flat, starts = table_for("tokenizers", tokenizer).encode_distinct(*chunks_in_buffer(texts, spaced=True))
        data = np.insert(flat, starts[1:], end_id).astype(kind)
        ends = (starts + np.arange(len(starts))) * data.itemsize
        return {"doc_id": ids, "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())}

    raw = stash(map_texts(plain, tokenise, "doc_id bigint, ids binary", arrow=True), "ids-raw")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = np.bincount(_values(batch.column(0), kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    counts = sorted(raw.select("ids").mapInArrow(frequencies, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect(), key=lambda r: (-r.n, r.id))
    spark = docs.sparkSession
    spark.createDataFrame([(rank, r.id, r.n) for rank, r in enumerate(counts)], "rank int, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r.id for r in counts), default=0) + 1, np.uint32)
    rank_of[[r.id for r in counts]] = np.arange(len(counts))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in counts) // SHARD_IDS))
    ordered = raw.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, before = TaskContext.get().partitionId(), 0, 0
        for ids, own in slices(batches, BLOCK_BYTES):
            flat = _values(own, kind)
            lengths = pc.binary_length(own).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
            payload = pack_block(ids, lengths, rank_of[flat], before)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            block, before = block + 1, before + len(flat)
        give_back()

    ordered.mapInArrow(encode, "shard int, block int, n_ids bigint, payload binary").write.parquet(f"{path}/blocks")
    discard(raw)
    return path


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows of a binary column, one after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files below path alone: doc_id, start, n_tokens, ids_crc32. The driver holds one number a
    shard and the table of ranks."""
    blocks = spark.read.schema("shard int, block int, n_ids bigint, payload binary").parquet(f"{path}/blocks")
    id_of = np.array([r.id for r in spark.read.schema("rank int, id bigint").parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    begins, total = {}, 0
    for shard in sorted(sizes):
        begins[shard] = total
        total += sizes[shard]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, none, lengths, ranks, before = unpack_block(payload.as_py())
                flat = id_of[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=none), "start": begins[shard] + before + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.select("shard", "payload").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
