"""Generators of texts and dictionaries for tests and benchmarks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def random_text(n: int, letters: str = "abcdefghijklmnopqrstuvwxyz", weights: list[float] | None = None, seed: int = 0) -> str:
    return "".join(random.Random(seed).choices(letters, weights, k=n))


def periodic_text(n: int, period: int = 256, noise: int = 31, seed: int = 0) -> str:
    """One random period again and again, with random characters between."""
    base, out, at = random_text(period, seed=seed), [], 0
    while at < n:
        part = base + random_text(noise, seed=seed + 1 + at)
        out.append(part)
        at += len(part)
    return "".join(out)[:n]


def fibonacci_text(n: int, first: str = "abaab", second: str = "ababa") -> str:
    a, b = first, second
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def adversarial_texts(n: int) -> dict[str, str]:
    thue = ""
    for i in range(n):
        thue += "ab"[bin(i).count("1") % 2]
    return {"one": "a" * n, "one_odd": "a" * n + "b" + "a" * n, "four": "abcd" * (n // 4), "two": "ab" * (n // 2) + "c", "thue": thue}


def sliding_phrases(texts: DataFrame, sizes: list[int], step: int) -> DataFrame:
    """text_id, k, pos, phrase: every step-th window of each size."""
    wide = texts.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).filter(F.length("text") >= F.col("k"))
    wide = wide.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("k") + 1, F.lit(step))))
    return wide.select("text_id", "k", "pos", F.expr("substring(text, pos, k)").alias("phrase"))


def budgeted_queries(texts: DataFrame, budget: int, step: int = 2) -> DataFrame:
    """text_id, k, pattern: distinct substrings of lengths 1, 1 + step, 1 + 2 step, .. in the order of length and place
    while their lengths sum to at most budget, for each text."""
    wide = texts.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(step)))).filter(F.length("text") >= F.col("k"))
    # a text's sum reaches the budget at the latest when each length has given one substring
    wide = wide.filter((F.col("k") + 1) * (F.col("k") + 1) / (4 if step == 2 else 2 * step) - F.col("k") <= budget)
    every = wide.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("k") + 1))).select("text_id", "k", "pos", F.expr("substring(text, pos, k)").alias("pattern"))
    first = every.groupBy("text_id", "k", "pattern").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("text_id").orderBy("k", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("k").over(w)).filter(F.col("used") <= budget).select("text_id", "k", "pattern")


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))
