"""Readers and writers, all through Spark, so that any file system it knows will do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T


def read_case(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file of blank-separated text, number q and q patterns: texts and patterns."""
    parts = spark.read.text(path, wholetext=True).select(T.words(F.col("value")).alias("w"))
    texts = parts.select(F.lit(0).cast("long").alias("text_id"), F.get("w", F.lit(0)).alias("text"))
    chosen = F.slice("w", F.lit(3), F.greatest(F.get("w", F.lit(1)).cast("int"), F.lit(0)))
    return texts, parts.select(F.posexplode(chosen).alias("pattern_id", "pattern")).withColumn("pattern_id", F.col("pattern_id").cast("long"))


def read_targets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file of q, q pattern lines, a number and as many target lines (blanks allowed): targets and patterns."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    q = F.get("l", F.lit(0)).cast("int")
    patterns = lines.select(F.posexplode(F.slice("l", F.lit(2), q)).alias("pattern_id", "pattern"))
    n = F.get("l", q + 1).cast("int")
    targets = lines.select(F.posexplode(F.slice(F.col("l"), q + 3, n)).alias("text_id", "text"))
    return targets.withColumn("text_id", F.col("text_id").cast("long")), patterns.withColumn("pattern_id", F.col("pattern_id").cast("long"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """One text a file: text_id from the digits of the file's name, text."""
    files = spark.read.text(path, wholetext=True).withColumn("name", F.input_file_name())
    return files.select(F.regexp_extract("name", r"(\d+)[^/\d]*$", 1).cast("long").alias("text_id"), F.col("value").alias("text"))


def read_strings(spark: SparkSession, path: str, column: str = "text", least_bytes: int = 2) -> DataFrame:
    """The strings of a parquet column that have at least so many bytes."""
    return spark.read.parquet(path).select(column).filter(F.octet_length(column) >= least_bytes)


def rows_with_nul(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col("text").contains("\0"))


def by_ranges(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Patterns given as ranges (text_id, pattern_id, l, r; from 1, inclusive) of texts."""
    joined = ranges.join(texts, "text_id")
    return joined.select("text_id", "pattern_id", F.expr("substring(text, l, greatest(r - l + 1, 0))").alias("pattern"))


def joined_outputs(texts: DataFrame, *by: str) -> DataFrame:
    """The texts of each value of the columns ``by`` (of all rows without them) as one, in the order of ids, with line
    feeds between; characters beyond 255 become that of 255."""
    parts = F.sort_array(F.collect_list(F.struct("text_id", T.to_latin(F.coalesce("text", F.lit(""))).alias("text"))))
    return texts.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def write_counts(counts: DataFrame, path: str) -> None:
    """One number a line in the order of pattern ids."""
    counts.orderBy("pattern_id").select(F.col("cnt").cast("string")).coalesce(1).write.text(path)


def write_report(results: DataFrame, path: str) -> None:
    """The report as text: a line of figures, the text, a line of three hyphens."""
    head = F.format_string("count = %d, maxlen_lo = %d, maxlen_hi = %d", "cnt", "maxlen_lo", "maxlen_hi")
    results.select(F.concat_ws("\n", head, F.col("t"), F.lit("---"))).write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows t, cnt, maxlen_lo, maxlen_hi of reports; iter is the number in the file's name, or 0. A text ends where its least
    length says if three hyphens follow there, so it may hold such lines itself; else at the next line of three hyphens."""
    files = spark.read.text(path, wholetext=True).withColumn("name", F.input_file_name())
    head = re.compile(r"count = (\d+), maxlen_lo = (\d+), maxlen_hi = (\d+)\n")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                while found := head.search(value, at):
                    cnt, low, high = map(int, found.groups())
                    end = found.end() + low
                    if value[end : end + 4] != "\n---":
                        end = value.find("\n---\n", found.end() - 1)
                        end = end if end >= 0 else len(value)
                    out.append((number, value[found.end() : end], cnt, low, high))
                    at = end + 4
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["iter", "t", "cnt", "maxlen_lo", "maxlen_hi"])

    number = F.coalesce(F.regexp_extract("name", r"iter_?(\d+)", 1).try_cast("int"), F.lit(0))
    return files.select(number.alias("iter"), "value").mapInArrow(parse, "iter int, t string, cnt int, maxlen_lo int, maxlen_hi int")


def write_strings(strings: DataFrame, path: str, column: str = "text") -> None:
    """One column ``text`` as Parquet."""
    strings.select(F.col(column).alias("text")).write.parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of lines with content:"|hex|" parts: rule_no, content (binary), depth, offset."""
    lines = spark.read.text(path).withColumn("rule_no", F.row_number().over(Window.orderBy(F.input_file_name(), F.monotonically_increasing_id())))
    return parse_rules(lines.select("rule_no", "value"))


def parse_rules(lines: DataFrame) -> DataFrame:
    found = lines.filter(F.col("value").rlike('content:')).select("rule_no", "value", F.explode(F.regexp_extract_all("value", F.lit(r'content:\s*"\|([0-9A-Fa-f ]+)\|"'), F.lit(1))).alias("hex"))
    option = {n: F.regexp_extract("value", rf"{n}:\s*(\d+)", 1).try_cast("int") for n in ("depth", "offset")}
    return found.select("rule_no", F.unhex(F.regexp_replace("hex", " ", "")).alias("content"), *[c.alias(n) for n, c in option.items()])
