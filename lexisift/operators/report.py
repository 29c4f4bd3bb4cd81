"""Summaries of extraction results (iter, t, cnt, maxlen_lo, maxlen_hi), and of lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T


def length_frequencies(strings: DataFrame, column: str) -> DataFrame:
    return strings.groupBy(F.length(column).alias("len")).agg(F.count("*").alias("cnt"))


def histogram(lengths: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """bin (1..bins, equal widths from the least to the greatest value, the last includes it) and cnt, bins that have any."""
    edges = lengths.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    n = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).otherwise(1)
    return lengths.join(F.broadcast(edges), F.lit(True)).filter(F.col(column).isNotNull()).groupBy(n.cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


def first_seen(results: DataFrame) -> DataFrame:
    """One row a text: that of its first iteration."""
    w = Window.partitionBy("t").orderBy("iter", "cnt", "maxlen_lo")
    return results.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def substantial(results: DataFrame) -> DataFrame:
    """Texts that are not blanks, hyphens and points alone."""
    return results.filter(T.filler_share(F.col("t")) < F.length("t"))


def summary(results: DataFrame, total_chars: int) -> DataFrame:
    """n_texts, extracted (sum of cnt * maxlen_lo over distinct texts) and percent of total_chars."""
    kept = substantial(first_seen(results))
    return kept.agg(F.count("*").alias("n_texts"), F.coalesce(F.sum(F.col("cnt") * F.col("maxlen_lo")), F.lit(0)).alias("extracted")).withColumn("percent", F.col("extracted") * 100.0 / total_chars)


def cumulative_curve(results: DataFrame) -> DataFrame:
    """iter, new_texts, all_texts: distinct texts that appear for the first time, and their running number."""
    first = results.groupBy("t").agg(F.min("iter").alias("iter"))
    new = first.groupBy("iter").agg(F.count("*").alias("new_texts"))
    return new.withColumn("all_texts", F.sum("new_texts").over(Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)))


def percentages(results: DataFrame, total_chars: int) -> DataFrame:
    """iter, lo and hi (sums of cnt times the bounds of lengths over the texts that appear there for the first time and are not
    filler), their percentages of total_chars, and those of all iterations up to this one."""
    kept = substantial(first_seen(results))
    by = kept.groupBy("iter").agg(*[F.sum(F.col("cnt") * F.col(f"maxlen_{x}")).alias(x) for x in ("lo", "hi")])
    w = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)  # a row an iteration
    own = [(F.col(x) * 100.0 / total_chars).alias(f"percent_{x}") for x in ("lo", "hi")]
    return by.select("iter", "lo", "hi", *own, *[(F.sum(x).over(w) * 100.0 / total_chars).alias(f"all_percent_{x}") for x in ("lo", "hi")])
