"""Mass search: texts (text_id, text) against a dictionary (pattern_id, pattern).

Counts include overlaps. Every pattern id has its own result, equal patterns too. The empty and the null pattern occur
nowhere; null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.operators import blocks, kernel, windows
from lexisift.plans import forms
from lexisift.plans.storage import stash


def match_counts(texts: DataFrame, patterns: DataFrame, zeros: bool = True, form: str | None = None) -> DataFrame:
    """text_id, pattern_id, cnt, first_pos (from 1, -1 where absent). zeros: a row for each text and pattern."""
    form = form or forms.choose(patterns)
    if form == "automaton":
        return kernel.counts(texts, patterns, zeros)
    texts = texts.select(F.col("text_id").cast("long").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    if form == "native":
        forms.check(patterns)
        found = blocks.counts(texts, patterns)
    else:
        found = windows.matches(texts, patterns).groupBy("text_id", "pattern_id").agg(F.sum(F.size("places")).alias("cnt"), F.min(F.array_min("places")).alias("first_pos"))
    if not zeros:
        return found
    grid = texts.select("text_id").crossJoin(patterns.select(F.col("pattern_id").cast("long").alias("pattern_id")))
    return grid.join(found, ["text_id", "pattern_id"], "left").select("text_id", "pattern_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("first_pos", F.lit(-1)).alias("first_pos"))


def mass_count(texts: DataFrame, patterns: DataFrame, form: str | None = None) -> DataFrame:
    return match_counts(texts, patterns, True, form).drop("first_pos")


def totals(texts: DataFrame, patterns: DataFrame, form: str | None = None) -> DataFrame:
    """pattern_id, cnt: occurrences over all texts, absent patterns with 0."""
    found = match_counts(texts, patterns, False, form).groupBy("pattern_id").agg(F.sum("cnt").alias("cnt"))
    return patterns.select(F.col("pattern_id").cast("long").alias("pattern_id")).join(found, "pattern_id", "left").select("pattern_id", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def exists(texts: DataFrame, patterns: DataFrame, mode: str = "exact") -> DataFrame:
    """text_id, pattern_id of the pairs that occur. mode: exact; aggressive and pairwise look only at adjacent links of
    the pattern's chain (aggressive also at those of the pattern without its first character), so they never miss and may err."""
    if mode == "exact":
        return match_counts(texts, patterns, False).select("text_id", "pattern_id")
    wanted = links(patterns, mode == "aggressive")
    numbered = _numbered(wanted.select(F.col("link").alias("pattern")))
    found = match_counts(texts, numbered, False).select("text_id", F.col("pattern_id").alias("link_id"))
    asked = wanted.join(numbered.select(F.col("pattern_id").alias("link_id"), F.col("pattern").alias("link")), "link").select("pattern_id", "link_id").distinct()
    need = asked.groupBy("pattern_id").agg(F.count("*").alias("need"))
    have = found.join(asked, "link_id").groupBy("text_id", "pattern_id").agg(F.count("*").alias("have"))
    return have.join(need, "pattern_id").filter("have = need").select("text_id", "pattern_id")


def _numbered(strings: DataFrame) -> DataFrame:
    """pattern_id, pattern of the distinct strings (pattern), written once so that ids stay the same."""
    return stash(strings.distinct().select(F.monotonically_increasing_id().alias("pattern_id"), "pattern"), "numbered")


def links(patterns: DataFrame, shifted: bool) -> DataFrame:
    """pattern_id, link: each two adjacent windows of the chain as one text, or the only one."""

    def of(text):
        c = T.chain(F.length(text))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.substring(text, F.get(c, i - 1)["off"] + 1, F.get(c, i - 1)["len"] + F.coalesce(F.get(c, i)["len"], F.lit(0))))
        return F.when(F.length(text) > 0, pairs).otherwise(F.array().cast("array<string>"))

    base = patterns.filter("pattern IS NOT NULL AND pattern != ''")
    out = base.select("pattern_id", F.explode(of(F.col("pattern"))).alias("link"))
    if shifted:
        tail = F.substring("pattern", F.lit(2), F.length("pattern"))
        out = out.union(base.select("pattern_id", F.explode(of(tail)).alias("link")))
    return out.distinct()


def match_positions(texts: DataFrame, patterns: DataFrame, form: str | None = None) -> DataFrame:
    """text_id, pattern_id, pos_end of every occurrence."""
    if (form or forms.choose(patterns)) == "automaton":
        return kernel.positions(texts, patterns)
    found = windows.matches(texts, patterns).select("text_id", "pattern_id", "n", F.explode("places").alias("pos"))
    return found.select("text_id", "pattern_id", (F.col("pos") + F.col("n") - 1).cast("int").alias("pos_end"))


def matches_by_end(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    return match_positions(texts, patterns).groupBy("text_id", "pos_end").agg(F.count("*").alias("cnt"))


def prefix_candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The patterns whose first power-of-two chunk occurs in some text: a superset of those that occur."""
    first = patterns.filter("pattern != ''").select("pattern_id", F.substring(F.col("pattern"), F.lit(1), T.bit_floor(F.length("pattern"))).alias("pattern"))
    return match_counts(texts, first, False).select("pattern_id").distinct()


def two_chunk_count(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, cnt of patterns that occur, by first and last power-of-two chunk: positions of both chunks are
    joined at their distance."""
    chunks = patterns.filter("pattern != ''").withColumn("n", F.length("pattern")).withColumn("p2", T.bit_floor(F.col("n")))
    one = chunks.select(F.substring(F.col("pattern"), F.lit(1), F.col("p2")).alias("pattern"))
    two = chunks.select(F.substring(F.col("pattern"), F.col("n") - F.col("p2") + 1, F.col("p2")).alias("pattern"))
    if forms.choose(one.union(two)) != "automaton":
        return windows.matches(texts, patterns).groupBy("text_id", "pattern_id").agg(F.sum(F.size("places")).alias("cnt"))
    numbered = _numbered(one.union(two))
    keys = numbered.select(F.col("pattern_id").alias("id"), F.col("pattern").alias("p"))
    asked = chunks.join(keys.withColumnRenamed("id", "one"), F.expr("substring(pattern, 1, p2) = p")).drop("p")
    asked = asked.join(keys.withColumnRenamed("id", "two"), F.expr("substring(pattern, n - p2 + 1, p2) = p")).select(F.col("pattern_id").cast("long"), "one", "two", (F.col("n") - F.col("p2")).alias("gap"))
    return kernel.paired_chunks(texts, numbered, [tuple(r) for r in asked.collect()])  # as large as the patterns, which were measured


def gated_positions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, n_windows: places whose window equals the first power-of-two chunk of some pattern, which the gate lets
    through and the join on the chunk confirms; a place counts once for each such length."""
    first = patterns.filter("pattern != ''").select(F.substring(F.col("pattern"), F.lit(1), T.bit_floor(F.length("pattern"))).alias("pattern"))
    found = windows.matches(texts, _numbered(first))
    return found.groupBy("text_id").agg(F.sum(F.size("places")).alias("n_windows"))


def prefiltered_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, cnt of patterns that occur, by two searches: first only the first chunk of each, then the whole of
    those that are left."""
    candidates = stash(patterns.join(prefix_candidates(texts, patterns), "pattern_id", "left_semi"), "candidates")
    return match_counts(texts, candidates, False).drop("first_pos")


def longest_prefix(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, prefix_len for every text and pattern; a dictionary too large to broadcast is taken in slices."""
    out = None
    for some in forms.slices(patterns):
        found = kernel.longest_prefixes(texts, some)
        out = found if out is None else out.unionByName(found)
    return out
