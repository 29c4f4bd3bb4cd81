"""Matcher: patterns are added, prepared once, and searched in payloads, in batches or in a stream.

Payloads are (payload_id, payload STRING or BINARY, which is searched byte by byte); patterns are (pattern_id, pattern, no_case, negated). Matching is without regard
to the case of A to Z where no_case is set. A negated pattern is found where it does not occur. Each payload is searched alone and
nothing is kept between payloads, so a stream may be of any length and is in append mode.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions.text import ascii_lower
from lexisift.operators.kernel import remembered
from lexisift.plans import forms

LOWER = {c: c + 32 for c in range(65, 91)}


class Matcher:
    def __init__(self, spark: SparkSession):
        self.spark, self.frames, self.rows = spark, [], None

    def add_patterns(self, patterns: DataFrame) -> Matcher:
        have = set(patterns.columns)
        flags = [F.col(c).cast("boolean").alias(c) if c in have else F.lit(False).alias(c) for c in ("no_case", "negated")]
        self.frames.append(patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern", *flags))
        self.rows = None
        return self

    def prepare(self) -> Matcher:
        """Patterns that are equal in text and flags are one, under the least id. The dictionary is measured and broadcast; one
        that is too large for that is an error."""
        every = self.frames[0]
        for f in self.frames[1:]:
            every = every.union(f)
        every = every.filter("pattern != ''").withColumn("pattern", F.when(F.col("no_case"), ascii_lower(F.col("pattern"))).otherwise(F.col("pattern")))
        forms.check(every)
        kept = every.groupBy("pattern", "no_case", "negated").agg(F.min("pattern_id").alias("pattern_id")).orderBy("pattern_id").collect()
        self.rows = [(r.pattern_id, r.pattern, r.no_case, r.negated) for r in kept]
        return self

    def pattern_count(self) -> int:
        if self.rows is None:
            self.prepare()
        return len(self.rows)

    def _map(self, payloads: DataFrame, each, schema: str) -> DataFrame:
        """Rows of each(payload_id, finder) of every payload; finder gives (place of the first character, of the last, row of
        a pattern) of every occurrence."""
        if self.rows is None:
            self.prepare()
        binary = dict(payloads.dtypes)["payload"] == "binary"
        rows, key = self.spark.sparkContext.broadcast(self.rows), uuid.uuid4().hex
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

        def machines() -> list:
            import ahocorasick

            out = []
            for fold in (False, True):
                words: dict[str, list[int]] = {}
                for k, (_, p, no_case, _) in enumerate(rows.value):
                    if no_case == fold:  # bytes are searched as the characters of the same numbers
                        words.setdefault(p.encode().decode("latin-1") if binary else p, []).append(k)
                machine = ahocorasick.Automaton()
                for p, own in words.items():
                    machine.add_word(p, (own, len(p)))
                if words:
                    machine.make_automaton()
                    out.append((fold, machine))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = remembered(key, machines)

            def occurrences(payload) -> Iterator[tuple[int, int, int]]:
                text = bytes(payload).decode("latin-1") if binary and payload else payload or ""
                for fold, machine in built:
                    for end, (own, n) in machine.iter(text.translate(LOWER) if fold else text):
                        for k in own:
                            yield end - n + 1, end, k

            for batch in batches:
                out: list[tuple] = []
                for payload_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += each(payload_id, occurrences(payload), rows.value)
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return payloads.select(F.col("payload_id").cast("long"), "payload").mapInArrow(run, schema)

    def search(self, payloads: DataFrame) -> DataFrame:
        """payload_id, pattern_id, cnt (of a negated pattern 0) of all patterns found; payloads may be a stream."""
        if self.rows is None:
            self.prepare()
        negated = [k for k, r in enumerate(self.rows) if r[3]]

        def each(payload_id, occurrences, rows) -> list[tuple]:
            cnt = Counter(k for _, _, k in occurrences)
            found = [(payload_id, rows[k][0], n) for k, n in sorted(cnt.items()) if not rows[k][3]]
            return found + [(payload_id, rows[k][0], 0) for k in negated if k not in cnt]

        return self._map(payloads, each, "payload_id bigint, pattern_id bigint, cnt bigint")

    def matches(self, payloads: DataFrame) -> DataFrame:
        """payload_id, pattern_id, pos_end (from 1; of bytes where payloads are binary) of every occurrence of patterns that are
        not negated, by where it begins and then by pattern."""

        def each(payload_id, occurrences, rows) -> list[tuple]:
            return [(payload_id, p, end + 1) for _, p, end in sorted((begin, rows[k][0], end) for begin, end, k in occurrences if not rows[k][3])]

        return self._map(payloads, each, "payload_id bigint, pattern_id bigint, pos_end int")

    def first_match(self, payloads: DataFrame, accepted: list[int] | None = None) -> DataFrame:
        """The first row of matches() of each payload that has one, of the accepted pattern ids (all if None): where a search ends
        as soon as a match is accepted."""
        wanted = None if accepted is None else set(accepted)

        def each(payload_id, occurrences, rows) -> list[tuple]:
            least = min(((begin, rows[k][0], end) for begin, end, k in occurrences if not rows[k][3] and (wanted is None or rows[k][0] in wanted)), default=None)
            return [] if least is None else [(payload_id, least[1], least[2] + 1)]

        return self._map(payloads, each, "payload_id bigint, pattern_id bigint, pos_end int")

    def totals(self, payloads: DataFrame) -> DataFrame:
        """payload_id, total: occurrences of all distinct patterns that are not negated, 0 included."""

        def each(payload_id, occurrences, rows) -> list[tuple]:
            return [(payload_id, sum(not rows[k][3] for _, _, k in occurrences))]

        return self._map(payloads, each, "payload_id bigint, total bigint")


def running_totals(stream: DataFrame, sink_path: str):
    """A streaming writer that adds each micro-batch's counts by pattern to a parquet table, one folder a batch, so that a batch
    that is run again replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("pattern_id").agg(F.sum("cnt").alias("cnt")).write.mode("overwrite").parquet(f"{sink_path}/batch={number}")

    return stream.writeStream.foreachBatch(add)
