"""Passages of a corpus (doc_id, text) that reappear in outputs (text_id, text): chunk, match, stitch, extend, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.operators import search
from lexisift.plans.storage import stash


def chunk_corpus(corpus: DataFrame, size: int = 100) -> DataFrame:
    """doc_id, chunk_no (from 0), chunk."""
    return corpus.select("doc_id", F.posexplode(T.chunks(F.col("text"), size)).alias("chunk_no", "chunk"))


def occurrences(strings: DataFrame, outputs: DataFrame, column: str) -> DataFrame:
    """Adds cnt, occurrences over all outputs, to strings; each distinct string is searched once."""
    distinct = strings.select(F.col(column).alias("pattern")).distinct()
    numbered = stash(distinct.select(F.monotonically_increasing_id().alias("pattern_id"), "pattern"), "strings")
    found = stash(search.totals(outputs, numbered), "strings-found")
    counted = numbered.join(found, "pattern_id").select(F.col("pattern").alias(column), "cnt")
    return strings.join(counted, strings[column].eqNullSafe(counted[column]), "left").drop(counted[column]).withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def stitch(chunks: DataFrame, cross_doc: bool = False) -> DataFrame:
    """Runs of consecutive chunks with cnt > 0: doc_id, run_no, first_chunk, n_chunks, core, and the missed chunks left and
    right of it (empty where there is none). cross_doc: runs go over the ends of documents, in the order of ids."""
    by = Window.orderBy("doc_id", "chunk_no") if cross_doc else Window.partitionBy("doc_id").orderBy("chunk_no")
    rows = chunks.withColumn("left", F.lag("chunk").over(by)).withColumn("right", F.lead("chunk").over(by))
    rows = rows.withColumn("miss", F.sum(F.when(F.col("cnt") > 0, 0).otherwise(1)).over(by)).filter("cnt > 0")
    keys = ["miss"] if cross_doc else ["doc_id", "miss"]
    parts = F.sort_array(F.collect_list(F.struct("doc_id", "chunk_no", "chunk", "left", "right")))
    runs = rows.groupBy(*keys).agg(parts.alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    runs = runs.select(first["doc_id"].alias("doc_id"), first["chunk_no"].alias("first_chunk"), F.size("p").alias("n_chunks"), F.array_join(F.col("p.chunk"), "").alias("core"), F.coalesce(first["left"], F.lit("")).alias("left"), F.coalesce(last["right"], F.lit("")).alias("right"), "p")
    return runs


def split_failed(runs: DataFrame) -> DataFrame:
    """Runs that do not occur as a whole (cnt = 0) go back to their chunks, each with its neighbours."""
    whole = runs.filter("cnt > 0").drop("p")
    pieces = runs.filter("cnt = 0").select(F.explode("p").alias("c")).select("c.doc_id", F.col("c.chunk_no").alias("first_chunk"), F.lit(1).alias("n_chunks"), F.col("c.chunk").alias("core"), F.coalesce("c.left", F.lit("")).alias("left"), F.coalesce("c.right", F.lit("")).alias("right"))
    return whole.drop("cnt").unionByName(pieces)


def extend(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Adds left_len and right_len, how many characters of each neighbour can be put to the core alone so that it still
    occurs. All lengths are searched at once; that a longer one occurs only if all shorter ones do makes the maximum right."""
    sides = []
    for side in ("left", "right"):
        grown = F.concat(F.right(F.col(side), F.col("k")), F.col("core")) if side == "left" else F.concat(F.col("core"), F.left(F.col(side), F.col("k")))
        every = runs.select("doc_id", "first_chunk", "core", side, F.explode(F.sequence(F.lit(0), F.length(side))).alias("k"))
        sides.append(every.withColumn("t", F.when(F.col("k") == 0, F.col("core")).otherwise(grown)).select("doc_id", "first_chunk", "k", F.lit(side).alias("side"), "t"))
    counted = occurrences(sides[0].union(sides[1]), outputs, "t")
    best = counted.filter("cnt > 0").groupBy("doc_id", "first_chunk").agg(*[F.max(F.when(F.col("side") == s, F.col("k"))).alias(f"{s}_len") for s in ("left", "right")])
    return runs.join(best, ["doc_id", "first_chunk"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("left_len", "right_len")})


def extract(corpus: DataFrame, outputs: DataFrame, size: int = 100, least: int = 200) -> DataFrame:
    """doc_id, first_chunk, t, cnt, maxlen_lo, maxlen_hi. Where core and both extensions occur as one, its length is known;
    else the length is at least that of the better side and less than that of both. At least ``least`` characters are asked for."""
    chunks = occurrences(chunk_corpus(corpus, size), outputs, "chunk")
    runs = stash(stitch(chunks), "runs")
    runs = stash(split_failed(occurrences(runs, outputs, "core")), "runs-split")
    grown = stash(extend(runs, outputs), "runs-grown")
    left, right = F.expr("right(left, left_len)"), F.expr("left(right, right_len)")
    grown = grown.withColumn("l", F.when(F.col("left_len") > 0, left).otherwise("")).withColumn("r", F.when(F.col("right_len") > 0, right).otherwise(""))
    grown = grown.withColumn("both", F.concat("l", "core", "r")).withColumn("side", F.when(F.col("left_len") >= F.col("right_len"), F.concat("l", "core")).otherwise(F.concat("core", "r")))
    found = occurrences(grown, outputs, "both").withColumnRenamed("cnt", "both_cnt")
    found = occurrences(found, outputs, "side")
    whole = F.col("both_cnt") > 0
    out = found.select("doc_id", "first_chunk", F.when(whole, F.col("both")).otherwise(F.col("side")).alias("t"), F.when(whole, F.col("both_cnt")).otherwise(F.col("cnt")).alias("cnt"), F.when(whole, F.length("both")).otherwise(F.length("side")).alias("maxlen_lo"), F.when(whole, F.length("both")).otherwise(F.length("both") - 1).alias("maxlen_hi"))
    return out.filter(F.col("maxlen_hi") >= least)


def long_runs(corpus: DataFrame, outputs: DataFrame, size: int, hits: int = 5) -> DataFrame:
    """Runs of at least so many consecutive chunks that occur one by one and as a whole: doc_id, first_chunk, n_chunks, cnt."""
    chunks = occurrences(chunk_corpus(corpus, size), outputs, "chunk")
    runs = stash(stitch(chunks).filter(F.col("n_chunks") >= hits).drop("p"), "runs")
    return occurrences(runs, outputs, "core").filter("cnt > 0").select("doc_id", "first_chunk", "n_chunks", "cnt")
