"""The automaton form: every text passes once through an Aho-Corasick automaton of all patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.plans import forms

ROWS = 200_000


def _automaton(rows: list[tuple[int, str]]):
    """The automaton, whose values are places in the list of distinct patterns; pattern ids and their places."""
    import ahocorasick

    place: dict[str, int] = {}
    for _, p in rows:
        if p:
            place.setdefault(p, len(place))
    machine = ahocorasick.Automaton()
    for p, i in place.items():
        machine.add_word(p, (i, len(p)))
    if place:
        machine.make_automaton()
    ids = np.array([i for i, _ in rows], np.int64)
    return machine, ids, np.array([place.get(p, -1) if p else -1 for _, p in rows], np.int64), len(place)


#: The automaton that this worker has built last, by the key of its dictionary; a worker goes on to other tasks.
_LAST: dict[str, tuple] = {}


def remembered(key: str, make):
    """What make() gives, made once in a worker for each dictionary; only the last is kept."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = make()
    return _LAST[key]


def _dictionary(patterns: DataFrame) -> list[tuple[int, str]]:
    """The patterns with an id, which the driver holds; their size is measured first and too large a dictionary is an error."""
    forms.check(patterns)
    rows = patterns.filter(F.col("pattern_id").isNotNull()).select(F.col("pattern_id").cast("long"), "pattern").orderBy("pattern_id").collect()
    return [(r.pattern_id, r.pattern) for r in rows]


def _run(texts: DataFrame, patterns: DataFrame, each, schema: str) -> DataFrame:
    rows, key = texts.sparkSession.sparkContext.broadcast(_dictionary(patterns)), uuid.uuid4().hex
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids, places, n = remembered(key, lambda: _automaton(rows.value))
        held, size = [], 0
        for batch in batches:
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = each(text_id, text.as_py() or "", machine, ids, places, n)
                held.append(own)
                size += len(own[0])
                if size > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)

    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(run, schema)


def counts(texts: DataFrame, patterns: DataFrame, zeros: bool) -> DataFrame:
    """text_id, pattern_id, cnt, first_pos (from 1, -1 if absent); zeros: a row for each text and pattern."""

    def each(text_id, text, machine, ids, places, n):
        number, first = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
        if n and text:
            for end, (i, length) in machine.iter(text):
                if not number[i]:
                    first[i] = end - length + 2
                number[i] += 1
        cnt, pos = number[places], first[places]  # -1 is the last, which is never counted
        if zeros:
            return np.full(len(ids), text_id, np.int64), ids, cnt, pos
        hit = np.flatnonzero(cnt)
        return np.full(len(hit), text_id, np.int64), ids[hit], cnt[hit], pos[hit]

    return _run(texts, patterns, each, "text_id bigint, pattern_id bigint, cnt bigint, first_pos int")


def positions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, pos_end (from 1) of every occurrence."""

    def each(text_id, text, machine, ids, places, n):
        if not (n and text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        found = [(i, end + 1) for end, (i, _) in machine.iter(text)]
        place = np.array([x for x, _ in found], np.int64)
        end = np.array([x for _, x in found], np.int32)
        order = np.argsort(places, kind="stable")
        low, high = np.searchsorted(places[order], place), np.searchsorted(places[order], place, side="right")
        take = np.repeat(np.arange(len(place)), high - low)
        at = np.arange(len(take)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[take] if len(take) else take
        return np.full(len(take), text_id, np.int64), ids[order][at], end[take]

    return _run(texts, patterns, each, "text_id bigint, pattern_id bigint, pos_end int")


def paired_chunks(texts: DataFrame, chunks: DataFrame, asked: list[tuple[int, int, int, int]]) -> DataFrame:
    """text_id, pattern_id, cnt: how often chunk ``one`` ends and chunk ``two`` ends ``gap`` later, for each asked
    (pattern_id, one, two, gap), in one pass over the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(asked)

    def each(text_id, text, machine, ids, places, n):
        ends: dict[int, list[int]] = {}
        if n and text:
            for end, (i, _) in machine.iter(text):
                ends.setdefault(i, []).append(end)
        have = {int(c): ends[p] for c, p in zip(ids, places, strict=True) if p in ends}
        found = []
        for pattern_id, one, two, gap in shared.value if have else ():
            if one in have and two in have and (cnt := len({e + gap for e in have[one]}.intersection(have[two]))):
                found.append((pattern_id, cnt))
        return np.full(len(found), text_id, np.int64), np.array([p for p, _ in found], np.int64), np.array([c for _, c in found], np.int64)

    return _run(texts, chunks, each, "text_id bigint, pattern_id bigint, cnt bigint")


#: Lengths of prefixes that are looked up in sets of a text's windows before the text itself is searched.
STEPS = (2, 4, 8, 16)


def longest_prefixes(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, prefix_len: the length of the longest prefix of each pattern that the text has. If a prefix
    occurs all shorter ones do, so few lengths are asked for: first powers of two in sets of all windows, which settle most
    patterns at once, then by halving in the text. A row for each text and pattern, in batches of bounded size."""
    rows = texts.sparkSession.sparkContext.broadcast(_dictionary(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in rows.value], np.int64)
        words = [p or "" for _, p in rows.value]
        held, who = [], []
        for batch in batches:
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                low, high = [0] * len(words), [min(len(p), len(text)) for p in words]
                live = [k for k, h in enumerate(high) if h]
                for size in STEPS:
                    windows = {text[i : i + size] for i in range(len(text) - size + 1)}
                    still = []
                    for k in live:
                        if high[k] >= size and words[k][:size] in windows:
                            low[k] = size
                            still.append(k)
                        else:
                            high[k] = min(high[k], size - 1)
                    live = still
                for k, p in enumerate(words):
                    a, b = low[k], high[k]
                    while a < b:
                        m = (a + b + 1) // 2
                        a, b = (m, b) if p[:m] in text else (a, m - 1)
                    low[k] = a
                held.append(np.array(low, np.int32))
                who.append(text_id)
                if len(held) * len(ids) > ROWS:
                    yield _grid(who, ids, held)
                    held, who = [], []
        if held and len(ids):
            yield _grid(who, ids, held)

    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(run, "text_id bigint, pattern_id bigint, prefix_len int")


def _grid(who: list[int], ids: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()).take(pa.array(np.repeat(np.arange(len(who)), len(ids)))), pa.array(np.tile(ids, len(who))), pa.array(np.concatenate(held))], names=["text_id", "pattern_id", "prefix_len"])
