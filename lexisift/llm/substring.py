"""Substring deduplication: suffix automata of reference shards, matching statistics, removal of long spans.

A window is ``window`` consecutive words of one document; a word goes when a window over it also starts in a document
with a smaller id. The reference for a document is thus all documents before it, which no broadcast can hold, so the reference
is cut into shards by content and each passage meets only the shard it can match:

1. Every window has a key, the least hash of its runs of SEED words; equal windows have equal keys. A maximal run of
   windows of one key is a segment, about one for 18 words.
2. Equal segments are grouped by a 128-bit hash. In all documents but the first they go whole.
3. Segments of one key that are not equal may still share windows, at the edges of repeated passages. They form a
   shard. Its segments are streamed in the order of ids through a suffix automaton of those before them; where the matching
   statistic reaches the window length, the window goes.
4. A key with more than SHARD_ROWS different segments (a very common phrase) would be one task's work. Its segments
   are cut by a second key, the least hash of runs of LONG_SEED words, and each pair of keys is a shard.
5. Where a pair of keys has too many segments still, its windows are spread out by their own hash, and each finds its
   first document there.

Word hashes are 64 bits wide and windows are told apart by 128 bits. Spans belong to a row, by its id and a hash of its
text (rk), since rows may share an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import discard, map_texts, stash, text_of, whole_groups
from lexisift.llm.common import parts as parts_of

SEED, LONG_SEED, SHARD_ROWS = 16, 40, 512
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of both bases and of their inverses, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        bases = [int(b) for b in BASES]
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(2 * n, 1 << 12), np.uint64(b), np.uint64)], dtype=np.uint64) for b in [*bases, *(pow(b, -1, 1 << 64) for b in bases)]]
    return _POWERS


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any runs of words of one document."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        p = powers(n)
        self.back = p[2:]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * q[:n], dtype=np.uint64)]) for h, q in zip((hashes, mixed(hashes)), p, strict=False)]

    def of(self, k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[k][end] - self.sums[k][begin]) * self.back[k][begin])


def window_keys(rolling: Rolling, begin: int, end: int, window: int, seed: int) -> np.ndarray:
    """The key of each window of words begin to end: the least hash of a run of so many words in it."""
    seed = min(seed, window)
    begin = np.arange(begin, end - seed + 1)
    least = rolling.of(0, begin, begin + seed)
    wide, total = 1, window - seed + 1
    while wide < total:
        step = min(wide, total - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    return least


def segments(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, rk, key, two hashes, first window and number of windows of every segment."""

    def step(ids: pa.Array, texts: list[str]) -> dict:
        rows, out = [], []
        for row, text in enumerate(texts):
            words = words_of(text)
            if len(words) < window:
                continue
            rolling = Rolling(word_hashes(words))
            keys = window_keys(rolling, 0, len(words), window, SEED)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            number = np.diff(first, append=len(keys))
            end = first + number + window - 1
            rows.append(np.full(len(first), row))
            out.append((keys[first].view(np.int64), rolling.of(0, first, end).view(np.int64), rolling.of(1, first, end).view(np.int64), first.astype(np.int32), number.astype(np.int32)))
        key, one, two, first, number = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
        return {"row": ids.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))), "key": key, "h1": one, "h2": two, "at": first, "n": number}

    names = ["row", "key", "h1", "h2", "at", "n"]
    found = map_texts(docs.select(F.struct("doc_id", "rk").alias("row"), "text"), step, f"row struct<doc_id: {dict(docs.dtypes)['doc_id']}, rk: bigint>, key bigint, h1 bigint, h2 bigint, at int, n int", names)
    return found.select("row.doc_id", "row.rk", *names[1:])


class Automaton:
    """A suffix automaton of several word sequences; states are numbered, 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if (q := nexts[last].get(w)) is not None:
                if length[q] != length[last] + 1:
                    q = self.split(last, w, q)
                last = q
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[state] = q if length[q] == length[p] + 1 else self.split(p, w, q)
            last = state

    def split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[int]) -> list[int]:
        """For each place the length of the longest match that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state, long, out = 0, 0, []
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                long = length[state]
            if (to := nexts[state].get(w)) is not None:
                state, long = to, long + 1
            else:
                long = 0
            out.append(long)
        return out


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as runs: begins and lengths."""
    begin = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return places[begin], np.diff(begin, append=len(places))


def repeated_windows(docs: DataFrame, window: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, rk, at, n: the runs of windows (n from window at on) that also start in a document with a smaller id. docs has
    doc_id, rk and text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stash(segments(docs.filter("doc_id IS NOT NULL"), window), "segments")
    same = ["key", "h1", "h2", "n"]
    distinct = stash(rows.groupBy(same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "segments-distinct", few=True)
    keys = distinct.groupBy("key").agg(F.count("*").alias("others"), F.min("first").alias("f"), F.max("last").alias("l")).filter("others > 1 AND f < l").select("key", "others")
    asked = stash(distinct.join(keys, "key", "left").filter("last > first OR others > 1").drop("last"), "segments-asked", few=True)
    discard(distinct)
    found = stash(rows.join(asked, same).select("doc_id", "rk", "key", "at", "n", "others", (F.col("doc_id") > F.col("first")).alias("later")).filter("later OR others > 1"), "segments-found", few=True)
    discard(rows, asked)
    whole = found.filter("later").select("doc_id", "rk", "at", "n")

    edges = found.filter("not later").groupBy("doc_id", "rk").agg(F.collect_list(F.struct("key", "at", "n", "others")).alias("own")).hint("merge")
    with_text = docs.dropna(subset=["doc_id"]).join(edges, ["doc_id", "rk"]).select("doc_id", "rk", "text", "own")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of segments, those of common keys cut by the second key."""
        for batch in parts_of(batches, 2):
            out: list[tuple] = []
            offsets, keys, places, numbers, others = lists(batch.column(3), 4)
            for row, (doc_id, rk, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                hashes = word_hashes(words_of(text.as_py()))
                rolling = None
                for i in range(offsets[row], offsets[row + 1]):
                    key, at, n = int(keys[i]), int(places[i]), int(numbers[i])
                    if others[i] <= shard_rows:
                        out.append((doc_id, rk, key, 0, at, hashes[at : at + n + window - 1].tobytes()))
                        continue
                    rolling = rolling or Rolling(hashes)
                    more = window_keys(rolling, at, at + n + window - 1, window, LONG_SEED).view(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]]))
                    for k, size in zip(first.tolist(), np.diff(first, append=n).tolist(), strict=True):
                        out.append((doc_id, rk, key, int(more[k]), at + k, hashes[at + k : at + k + size + window - 1].tobytes()))
            if out:
                doc_id, rk, key, more, at, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, batch.column(0).type), pa.array(rk, pa.int64()), pa.array(key, pa.int64()), pa.array(more, pa.int64()), pa.array(at, pa.int32()), pa.array(words, pa.binary())], names=["doc_id", "rk", "key", "more", "at", "words"])

    parts = stash(with_text.mapInArrow(read, f"doc_id {kind}, rk bigint, key bigint, more bigint, at int, words binary"), "segments-words")
    common = stash(parts.groupBy("key", "more").agg(F.count("*").alias("others")).filter(F.col("others") > shard_rows).drop("others"), "keys-common", few=True)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["key", "more"]):
            out_row, out_at, out_n = [], [], []
            ids, places, words = table["doc_id"].to_pylist(), table["at"].to_pylist(), table["words"].to_pylist()
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                automaton, waiting = Automaton(), []
                for i in range(a, b):
                    if i > a and ids[i] != ids[i - 1]:
                        for own in waiting:
                            automaton.add(own)
                        waiting = []
                    own = np.frombuffer(words[i], np.uint64).tolist()
                    waiting.append(own)
                    if len(automaton.next) > 1 and (hit := np.flatnonzero(np.array(automaton.statistics(own)) >= window) - window + 1).size:
                        at, n = runs(hit)
                        out_row += [i] * len(at)
                        out_at.append(at + places[i])
                        out_n.append(n)
            if out_row:
                yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(pa.array(out_row)) for c in ("doc_id", "rk")), pa.array(np.concatenate(out_at), pa.int32()), pa.array(np.concatenate(out_n), pa.int32())], names=["doc_id", "rk", "at", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (at, words) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                hashes = np.frombuffer(words, np.uint64)
                rolling, begin = Rolling(hashes), np.arange(len(hashes) - window + 1)
                one, two = (rolling.of(k, begin, begin + window).view(np.int64) for k in (0, 1))
                same_row = pa.array(np.full(len(begin), row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same_row), batch.column(1).take(same_row), pa.array(at.as_py() + begin, pa.int32()), pa.array(one), pa.array(two)], names=["doc_id", "rk", "at", "h1", "h2"])

    shards = parts.join(common, ["key", "more"], "left_anti").select("key", "more", "doc_id", "rk", "at", "words")
    matched = shards.repartition("key", "more").sortWithinPartitions("key", "more", "doc_id", "rk", "at").mapInArrow(match, f"doc_id {kind}, rk bigint, at int, n int")
    spread = stash(parts.join(common, ["key", "more"], "left_semi").select("doc_id", "rk", "at", "words").mapInArrow(windows, f"doc_id {kind}, rk bigint, at int, h1 bigint, h2 bigint"), "windows")
    firsts = stash(spread.groupBy("h1", "h2").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l")).filter("f < l").drop("l"), "windows-first", few=True)
    spread = spread.join(firsts, ["h1", "h2"]).filter("doc_id > f").select("doc_id", "rk", "at", F.lit(1).alias("n"))
    return whole.union(matched).union(spread)


def _cut(docs: DataFrame, window: int, shard_rows: int, id_col: str, text_col: str) -> DataFrame:
    """Every row as a struct, and spans: the words that go, as an array of (at, n) of windows (null for none)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("rk"), text_of(text_col).alias("text"))
    spans = repeated_windows(rows.drop("row"), window, shard_rows).groupBy("doc_id", "rk").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    # the spans of a corpus are shuffled like its texts, at every size
    return rows.drop("text").join(stash(spans, "spans").hint("merge"), ["doc_id", "rk"], "left").select("row", "spans")


def lists(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Of an array of lists of structs: where each row's begin (one more for the end; none for null), and the fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(width))


def gone_words(n_words: int, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by windows at .. at + n - 1."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_words(texts: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Of each text: its row, its number of words, and the words that stay."""
    offsets, at, n = lists(spans, 2)
    for row, text in enumerate(texts):
        words = words_of(text.as_py() or "")
        a, b = offsets[row], offsets[row + 1]
        if a == b:
            yield row, len(words), words
        else:
            gone = gone_words(len(words), at[a:b], n[a:b], window)
            yield row, len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def removal_digests(docs: DataFrame, window: int = 50, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, with one blank between).

    Words are runs without ASCII white space. Null and empty texts have no words. Repeats within a document, and
    between rows with one id, stay, whatever their texts; each row is cut by its own text. Documents with a null id are neither
    reference nor cut. Texts of any length are read whole; other columns are not read. An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    joined = _cut(plain, window, shard_rows, "doc_id", "text").select("row.doc_id", "row.text", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            n, removed, sha = [], [], []
            for _, number, kept in kept_words(batch.column(1), batch.column(2), window):
                n.append(number)
                removed.append(number - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(digest, f"doc_id {dict(docs.dtypes)[id_col]}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The documents with the repeated words cut out and all their columns, which may bear any name. Uncut texts stay as
    they are, cut ones have one blank between words; size_col, if given, gets the new number of code points. Cases as in
    removal_digests()."""
    joined = _cut(docs, window, shard_rows, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    joined = joined.select(*[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], "spans")
    at, sized = docs.columns.index(text_col), docs.columns.index(size_col) if size_col else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, at):
            columns, marks = batch.columns[:-1], batch.columns[-1]
            hit = pc.fill_null(pc.greater(pc.list_value_length(marks), 0), False)
            rows = pa.array(np.flatnonzero(hit.to_numpy(zero_copy_only=False)))
            if len(rows):
                texts = columns[at].to_pylist()
                for row, (_, _, kept) in zip(rows.to_pylist(), kept_words(columns[at].take(rows), marks.take(rows), window), strict=True):
                    texts[row] = b" ".join(kept).decode()
                columns[at] = pa.array(texts, columns[at].type)
                if sized is not None:
                    columns[sized] = pc.if_else(hit, pc.utf8_length(columns[at]).cast(columns[sized].type), columns[sized])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, joined.drop("spans").schema).toDF(*docs.columns)
