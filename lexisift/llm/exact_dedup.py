"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts, for each document's hash, its slot of a Bloom filter and keeps the slots that were set twice or
more, as bitmaps of blocks. Pass two tests every row: a hash whose slot was not set twice occurs once, so its row passes
straight through. Only possibly repeated rows are shuffled and grouped, by their whole SHA-256, so a false positive costs a
shuffle and never changes a result.

The filter has SLOTS_A_ROW slots a row at every size. Up to BROADCAST_BYTES it is broadcast; a larger one meets the rows
in a shuffle by block, in which a block that very many copies fall into is spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import discard, stash, text_of

#: Slots of a block (a bitmap of 4 KB), slots for each row, largest filter that is broadcast, rows of a block that one task takes.
BLOCK_BITS, SLOTS_A_ROW, BROADCAST_BYTES, BLOCK_ROWS = 32_768, 16, 128 << 20, 1 << 20


def fingerprint(text_col: str) -> Column:
    """SHA-256 (binary) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), "[\\x20\\x09-\\x0D]+", ""), 256))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as one struct, its id, its hash and its number of code points; the user's columns cannot clash with these."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), fingerprint(text_col).alias("sha"), F.length(text_of(text_col)).alias("size"))


def _slot(blocks: int) -> tuple[Column, Column]:
    """Block and place in it of a hash."""
    h = F.xxhash64("sha")
    return F.pmod(h, F.lit(blocks)), F.pmod(F.shiftright(h, 40), F.lit(BLOCK_BITS))


def repeated_slots(hashed: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """Pass one: for each block the bitmap of the slots set at least twice and how many rows set them, and the number of blocks."""
    blocks = 1
    while blocks * BLOCK_BITS < SLOTS_A_ROW * n_rows:
        blocks *= 2
    block, slot = _slot(blocks)
    twice = hashed.select(block.alias("block"), slot.alias("slot")).groupBy("block", "slot").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(slot)").alias("bitmap"), F.sum("n").alias("rows")), blocks


def with_maybe(hashed: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Pass two: adds whether a row's hash may be repeated."""
    block, slot = _slot(blocks)
    marked = hashed.withColumn("block", block).withColumn("slot", slot)
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        joined = marked.join(F.broadcast(bitmaps), "block", "left")
    else:
        parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
        full = bitmaps.filter(F.col("rows") > BLOCK_ROWS).select("block", parts.alias("parts"))  # at most one for BLOCK_ROWS rows
        marked = marked.join(full, "block", "left").withColumn("part", F.pmod(F.xxhash64("id", "size"), F.coalesce("parts", F.lit(1))))
        spread = bitmaps.select("block", "bitmap", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
        joined = marked.join(spread.hint("merge"), ["block", "part"], "left")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("bit_get", byte, F.pmod("slot", F.lit(8)).cast("int")) == 1
    return joined.withColumn("maybe", F.coalesce(is_set, F.lit(False))).select(*hashed.columns, "maybe")


def _winners(maybe: DataFrame, least: int = 2) -> DataFrame:
    """Of every hash of so many rows the id that stays (longest, then smallest id; null ids last), its size and the number of rows."""
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = maybe.groupBy("sha").agg(best.alias("best"), F.count("*").alias("number")).filter(F.col("number") >= least)
    return groups.select(F.col("sha").alias("sha2"), F.col("best.id").alias("keep"), (-F.col("best.size")).alias("keep_size"), "number")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space; a null text counts as the empty text, and all
    empty texts are equal. The row with the most code points stays, then the smallest id, null ids last. Rows that share id
    and text are one document to this rule and are marked alike. Texts of any length are read whole. Other columns are not
    read and may bear any name. An empty table gives an empty one.
    """
    narrow = stash(_hashed(docs, id_col, text_col).drop("row"), "exact-hashes")
    bitmaps, blocks = repeated_slots(narrow, narrow.count())
    bitmaps = stash(bitmaps, "exact-slots")
    tested = with_maybe(narrow, bitmaps, blocks)
    maybe = tested.filter("maybe")
    winners = stash(_winners(maybe), "exact-winners", few=True)
    joined = maybe.join(winners, F.col("sha") == F.col("sha2"), "left").select("id", "sha", "keep", "number")
    kind = dict(narrow.dtypes)["id"]
    alone = tested.filter("NOT maybe").select("id", "sha", F.lit(None).cast(kind).alias("keep"), F.lit(None).cast("long").alias("number"))
    single = F.col("number").isNull()
    return alone.unionByName(joined).select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("number", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns, which may bear any name.

    Equal texts, the empty text, nulls and the order of preference are as in mark_duplicates(). Of rows that are equal in
    text, length and id as well, one stays. Rows whose text occurs once are not shuffled while the filter is broadcast.
    An empty table gives an empty one.
    """
    hashed = _hashed(docs, id_col, text_col)
    narrow = stash(hashed.drop("row"), "exact-hashes")
    bitmaps, blocks = repeated_slots(narrow, narrow.count())
    bitmaps = stash(bitmaps, "exact-slots")
    winners = stash(_winners(with_maybe(narrow, bitmaps, blocks).filter("maybe"), 1), "exact-winners", few=True)
    discard(narrow)
    tested = with_maybe(hashed, bitmaps, blocks)
    # dealt by id and size as well, so that a large group of copies is spread over tasks and only rows that stay meet by hash
    best = (F.col("sha") == F.col("sha2")) & F.col("id").eqNullSafe(F.col("keep")) & (F.col("size") == F.col("keep_size"))
    kept = tested.filter("maybe").join(winners, best, "left_semi").dropDuplicates(["sha"])
    return tested.filter("NOT maybe").select("row").unionByName(kept.select("row")).select("row.*")
