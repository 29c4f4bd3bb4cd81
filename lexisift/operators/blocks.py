"""The form without Python: the blocks of the texts meet the same stretches of the patterns in a broadcast join on a hash.

A text is cut into blocks of q characters. An occurrence of a pattern of 2q - 1 characters or more holds a whole block, and the
first one it holds begins at one of the pattern's first q places. So these q stretches of every pattern are looked up for
each block, and what is found is compared as a whole, at its place: each occurrence is found once, whatever its text has
besides, and a text costs one look-up for every q characters instead of a search for each pattern. Patterns of similar length
share a q, of Q at most. Texts and patterns are held in UTF-32, where places are those of code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.plans.storage import stash

#: Characters of a block at most, and bytes of a character.
Q, WIDTH = 32, 4


def _stretch(units, begin, size):
    """So many characters from a place, counted from 0."""
    return F.substring(units, begin * WIDTH + 1, size * WIDTH)


def counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, cnt, first_pos (from 1) of the pairs that occur, for each row of texts and each of patterns."""
    n = F.length("pattern")
    some = patterns.filter("pattern != ''").select(F.col("pattern_id").cast("long"), F.encode("pattern", "UTF-32").alias("units"), n.alias("n"), T.bit_floor(F.least(n, F.lit(2 * Q - 1))).alias("class"))
    some = stash(some.withColumn("pattern_no", F.monotonically_increasing_id()), "patterns")  # written, so that numbers stay the same
    sizes = some.groupBy("class").agg(F.min(F.least((F.col("n") + 1) / 2, F.lit(Q))).cast("int").alias("q"))
    listed = sorted({r.q for r in sizes.collect()}) or [1]  # one for each power of two up to 2 * Q at most
    keys = some.join(F.broadcast(sizes), "class").select("pattern_no", "units", "q", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("off"))
    keys = keys.select("pattern_no", "off", F.xxhash64("q", _stretch(F.col("units"), F.col("off"), F.col("q"))).alias("key"))

    blocks = texts.select("text_id", F.monotonically_increasing_id().alias("text_no"), F.length("text").alias("size"), F.encode("text", "UTF-32").alias("text_units"))
    blocks = blocks.select("*", F.explode(F.array(*map(F.lit, listed))).alias("q"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - F.col("q"), F.lit(0)), F.col("q"))).alias("block"))
    blocks = blocks.withColumn("key", F.xxhash64("q", _stretch(F.col("text_units"), F.col("block"), F.col("q"))))
    near = blocks.join(F.broadcast(keys), "key").filter("block >= off").withColumn("begin", F.col("block") - F.col("off"))
    found = near.join(F.broadcast(some.drop("class")), "pattern_no").filter(_stretch(F.col("text_units"), F.col("begin"), F.col("n")) == F.col("units"))
    return found.groupBy("text_no", "text_id", "pattern_no", "pattern_id").agg(F.count("*").alias("cnt"), (F.min("begin") + 1).alias("first_pos")).select("text_id", "pattern_id", "cnt", "first_pos")
