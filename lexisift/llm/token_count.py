"""Token counts by rank-synchronous array merging.

Distinct pre-tokens are held as one flat symbol array with a sequence number beside each symbol. In each round every
sequence merges its pair of lowest rank, all sequences at once, until no sequence has a pair left; the surviving
symbols are counted. Symbols are the pieces of a sentencepiece BPE model: two neighbours may merge when their
concatenation is a piece, and its score is the rank. Characters that are no piece count as their UTF-8 bytes.

Two properties of the model, which are checked when it is read, keep the rounds of long pre-tokens few. Where no piece holds two
characters side by side, no token crosses them, so a pre-token is cut there. Where all pieces that can be merged from a
piece rank behind it, merges to it make no pair of a lower or the same rank, so a round takes all of them in a
sequence, overlapping ones from the left; of other pieces it takes the leftmost only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexisift.llm.common import keyed, map_texts
from lexisift.llm.sentencepiece_codec import model_for

NONE = np.int64(1) << 62


class PairRanks:
    """Ranks of the pairs of a sentencepiece BPE model, as sorted arrays."""

    def __init__(self, path: str):
        model = model_for(path)
        pieces, score = model.pieces, model.library.get_score
        order = {s: r for r, s in enumerate(sorted({score(i) for i in pieces.values()}, reverse=True))}
        found = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                if (a := pieces.get(piece[:k])) is not None and (b := pieces.get(piece[k:])) is not None:
                    found[a << 32 | b] = (order[score(i)], i)
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[int(k)][0] for k in self.keys], np.int64)
        self.made = np.array([found[int(k)][1] for k in self.keys], np.int64)
        ranked = {i: order[score(i)] for i in pieces.values()}
        self.ascending = np.ones(len(order), bool)
        for key, (rank, _) in found.items():
            for part in (key >> 32, key & 0xFFFFFFFF):
                if rank <= ranked[part]:
                    self.ascending[ranked[part]] = False
        inside = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        self.inside = np.array(sorted(ord(p[0]) << 32 | ord(p[1]) for p in inside), np.int64)
        self.symbol = np.full(0x110000, -1, np.int64)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of merging a with b; NONE where they do not merge."""
        key = np.where((a < 0) | (b < 0), -1, a << 32 | np.maximum(b, 0))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)


    def cuts(self, points: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Where a sequence begins: with a chunk, and between two characters that no piece holds side by side; the first counts 0."""
        out = np.zeros(len(points), bool)
        key = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        out[1:] = (chunk[1:] != chunk[:-1]) | (self.inside[at] != key)
        return out


def utf8_width(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def count_synchronously(ranks: PairRanks, chunks: list[str]) -> np.ndarray:
    """The number of tokens of every chunk."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbols = ranks.symbol[points]
    chunk = np.repeat(np.arange(len(chunks)), sizes)
    out = np.bincount(chunk, np.where(symbols < 0, utf8_width(points), 1), len(chunks)).astype(np.int64)
    owner = np.cumsum(ranks.cuts(points, chunk))  # sequences: the parts of chunks that no token crosses
    chunk = chunk[np.flatnonzero(np.diff(owner, prepend=-1))]

    def pair(left: np.ndarray, right: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = ranks.find(left, right)
        return np.where(at == to, rank, NONE), made

    if len(symbols) < 2:
        return out
    # rank[i] and made[i]: of the pair that begins at i
    rank, made = pair(symbols[:-1], symbols[1:], owner[:-1], owner[1:])
    rank, made = np.append(rank, NONE), np.append(made, -1)
    while True:
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.minimum.reduceat(rank, first)
        lengths = np.diff(first, append=len(owner))
        live = lowest < NONE
        if not live.any():
            return out
        keep = np.repeat(live, lengths)  # sequences without a pair are done
        symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
        lengths, lowest = lengths[live], lowest[live]
        first = np.cumsum(lengths) - lengths
        here = np.flatnonzero(rank == np.repeat(lowest, lengths))
        leftmost = np.diff(owner[here], prepend=-1) != 0
        run = np.flatnonzero(leftmost | (np.diff(here, prepend=-2) != 1))
        other = (np.arange(len(here)) - np.repeat(run, np.diff(run, append=len(here)))) % 2 == 0  # of neighbours every other one
        at = here[leftmost | other & ranks.ascending[rank[here]]]
        symbols[at] = made[at]
        np.subtract.at(out, chunk[owner[at]], 1)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        to = np.cumsum(stay)[at] - 1  # places after the removal
        symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
        for edge in (to - 1, to):
            left = edge[(edge >= 0) & (edge < len(symbols) - 1)]
            rank[left], made[left] = pair(symbols[left], symbols[left + 1], owner[left], owner[left + 1])
        rank[-1] = NONE


class CountTable:
    """Counts by distinct pre-token, for one worker; emptied at ``limit`` entries."""

    def __init__(self, path: str, limit: int = 400_000):
        self.ranks, self.limit, self.counts = PairRanks(path), limit, {}

    def look_up(self, chunks: list[str]) -> np.ndarray:
        if len(self.counts) > self.limit:
            self.counts = {}
        fresh = list(set(chunks).difference(self.counts))
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            self.counts.update(zip(some, count_synchronously(self.ranks, some).tolist(), strict=True))
        return np.fromiter(map(self.counts.__getitem__, chunks), np.int64, len(chunks))


_TABLES: dict[str, CountTable] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    Null and empty texts have 0 bytes and 0 tokens, whole texts are counted however long. Null ids, repeated rows and rows that share
    an id each have a result; other columns are not read; an empty table gives an empty one.
    A model whose pieces cross the marker is counted with each whole text as one pre-token.
    """

    def step(ids: pa.Array, texts: list[str]) -> dict:
        if path not in _TABLES:
            _TABLES[path] = CountTable(path)
        model = model_for(path)
        chunks = [model.chunks(x) for x in texts]
        ends = np.cumsum([len(c) for c in chunks])
        total = np.concatenate([[0], np.cumsum(_TABLES[path].look_up([c for own in chunks for c in own]))])
        n = np.diff(total[ends], prepend=0)
        return {"doc_id": ids, "n_bytes": pc.binary_length(pa.array(texts, pa.large_string()).cast(pa.large_binary())).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit}

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean")
