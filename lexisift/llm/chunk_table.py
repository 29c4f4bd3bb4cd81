"""Distinct-chunk tables: every distinct chunk of a partition is tokenised once, ids are joined back by position.

A chunk is a stretch of text between two places that no token crosses, so the ids of a text are those of
its chunks, one after the other. A table serves all batches that its Python worker sees. When it holds ``limit``
chunks, those met in one batch only go, so its memory does not grow with the input; that costs time and changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode White_Space, as the tokenizers' \s has it; Python's \s also holds U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space beside the blank and the line feed, and Python's four more.
RARE = [c for c in SPACES if c not in " \n"] + list("\x1c\x1d\x1e\x1f")
SPACED = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
UNSPACED = re.compile(f"[^{SPACES}]+")


class ChunkTable:
    """Chunks by code; the ids of code c are flat[start[c] : start[c] + count[c]].

    tokenise gives each chunk's ids as the bytes of unsigned 32-bit integers, which Python's garbage collector need not visit;
    last_id is the largest id there can be.
    """

    def __init__(self, tokenise: Callable[[list[str]], list[bytes]], limit: int = 300_000, last_id: int = 0xFFFFFFFF):
        self.tokenise, self.limit, self.last_id = tokenise, limit, last_id
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Keeps the chunks met in the most batches, at least two and not more than half of limit; they are then as if met once."""
        keep = np.argsort(-self.met, kind="stable")[: min(int((self.met > 1).sum()), self.limit // 2)]
        names, flat, count = list(self.codes), self.ids(keep), self.count[keep]
        self.codes = dict(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        self.flat, self.used = flat, len(flat)
        self.start, self.count, self.met = np.cumsum(count) - count, count, np.ones(len(keep), np.int32)

    def code(self, chunks: list[str]) -> np.ndarray:
        """The code of every chunk; chunks not met before are tokenised, each once."""
        if len(self.codes) > self.limit:
            self.shrink()
        if fresh := list(set(chunks).difference(self.codes)):
            ids = self.tokenise(fresh)
            count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            total, used = int(count.sum()), self.used
            if used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * total, np.uint32)])
            self.flat[used : used + total] = np.frombuffer(b"".join(ids), np.uint32)
            self.start = np.concatenate([self.start, used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.met = np.concatenate([self.met, np.zeros(len(count), np.int32)])
            self.used += total
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh)), strict=True))
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        self.met[codes] += 1  # once a batch, however often a chunk stands in it
        return codes

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the chunks with these codes, in this order."""
        count = self.count[codes]
        ends = np.cumsum(count)
        place = np.int32 if self.used + len(codes) < 1 << 30 and (not len(ends) or ends[-1] < 1 << 30) else np.int64
        at = np.repeat((self.start[codes] - (ends - count)).astype(place), count)
        at += np.arange(len(at), dtype=place)
        return self.flat[at]

    def encode_distinct(self, distinct: list[str], which: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For chunks given as places in a list of distinct ones, and where each text's chunks begin (one more for the
        end): all ids, where each text's ids begin (one more for the end)."""
        codes = self.code(distinct)[which]
        return self.ids(codes), np.concatenate([[0], np.cumsum(self.count[codes])])[begins]

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts given as chunks: all ids, where each text's ids begin (one more for the end), all codes."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code([c for chunks in texts for c in chunks])
        before = np.concatenate([[0], np.cumsum(self.count[codes])])
        return self.ids(codes), before[np.concatenate([[0], np.cumsum(sizes)])], codes


def spaced_chunks(text: str) -> list[str]:
    """White space with the word that follows it. Byte-level pre-tokens never go from a word on into white space."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in RARE):
        return SPACED.findall(text)
    parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


#: Classes of bytes: white space, ASCII letter, punctuation, other ASCII, first byte of a Latin letter (three kinds, by which
#: second bytes make none: × and ÷, İ, whose lower case is two characters, and none), second byte (four kinds), other.
SPACE, LETTER, PUNCTUATION, PLAIN, LEAD_C3, LEAD_C4, LEAD, SECOND, SECOND_97, SECOND_B7, SECOND_B0, OTHER = range(12)


def _byte_class(c: int) -> int:
    if c < 128:
        return SPACE if c in b" \t\n\x0b\x0c\r" else LETTER if chr(c).isalpha() else PUNCTUATION if 32 < c < 127 and not chr(c).isalnum() else PLAIN
    if c < 0xC0:
        return {0x97: SECOND_97, 0xB7: SECOND_B7, 0xB0: SECOND_B0}.get(c, SECOND)
    return {0xC3: LEAD_C3, 0xC4: LEAD_C4}.get(c, LEAD if 0xC5 <= c <= 0xC9 else OTHER)


#: What ends with a byte: a Latin letter, other ASCII, white space, or something that is not looked into.
ENDS_LETTER, ENDS_ASCII, ENDS_SPACE, ENDS_OTHER = range(4)


def _end(before: int, c: int) -> int:
    if c <= PLAIN:
        return (ENDS_SPACE, ENDS_LETTER, ENDS_ASCII, ENDS_ASCII)[c]
    barred = {LEAD_C3: (SECOND_97, SECOND_B7), LEAD_C4: (SECOND_B0,), LEAD: ()}
    return ENDS_LETTER if before in barred and SECOND <= c <= SECOND_B0 and c not in barred[before] else ENDS_OTHER


CLASS = np.array([_byte_class(c) for c in range(256)], np.uint8)
END = np.array([_end(x >> 4, x & 15) for x in range(256)], np.uint8)
#: By what ends before a byte (times 16) and the byte's class: whether a chunk begins; with and without white space.
SPACED_CUT = np.array([x & 15 == SPACE and x >> 4 in (ENDS_LETTER, ENDS_ASCII) or x & 15 == PUNCTUATION and x >> 4 == ENDS_LETTER for x in range(256)])
UNSPACED_CUT = np.array([x & 15 != SPACE and x >> 4 == ENDS_SPACE or x & 15 == PUNCTUATION and x >> 4 == ENDS_LETTER for x in range(256)])
TO_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def chunks_in_buffer(texts: pa.Array, spaced: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks of many texts at once, found in their bytes: distinct ones, which of them stand where, and where each
    text's begin (one more for the end).

    A cut comes before white space that follows other characters, and before punctuation that follows a Latin letter; no
    pre-token crosses these. spaced: white space stays with the word behind it; else it goes, and A to Z are lowered.
    Texts with the beginning of a special token are cut as strings.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if b"<|" in memoryview(data).tobytes():
        cut = [(spaced_chunks if spaced else unspaced_chunks)(t.as_py().decode()) for t in texts]
        whole = pa.array([c for own in cut for c in own], pa.large_string()).dictionary_encode()
        return whole.dictionary.to_pylist(), whole.indices.to_numpy(), np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    kind = CLASS[data]
    before = np.empty_like(kind)
    before[:1], before[1:] = SPACE, kind[:-1]
    end = END[(before << 4) | kind]
    before[1:] = end[:-1]
    begin = np.append((SPACED_CUT if spaced else UNSPACED_CUT)[(before << 4) | kind], False)
    begin[offsets] = True
    begin[-1] = False
    if spaced:
        places = np.flatnonzero(begin)
        starts = np.append(places, len(data))
    else:
        solid = kind != SPACE
        places = np.flatnonzero(begin[:-1] & solid)
        data = TO_LOWER[data[solid]]
        starts = np.append(places - np.searchsorted(np.flatnonzero(~solid), places), len(data))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return chunks.dictionary.cast(pa.large_string()).to_pylist(), chunks.indices.to_numpy(), np.searchsorted(places, offsets)


def unspaced_chunks(text: str) -> list[str]:
    """Words; for tokenizers that drop white space."""
    return UNSPACED.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Chunks of these characters alone are cut into pre-tokens here; there Python's classes are those of the libraries.
LATIN = re.compile(f"[\\n -~{LETTERS.replace('ø-ɏ', 'ø-įı-ɏ')}]*")
SHORTENED = "'s|'t|'re|'ve|'m|'ll|'d|"
BYTE_LEVEL = re.compile(f"{SHORTENED} ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORD_LEVEL = re.compile(f"{SHORTENED}[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")
SPACED_LETTERS, PLAIN_LETTERS = re.compile(f" [{LETTERS}]+"), re.compile(f"[{LETTERS}]+")


class PreTokenEncoder:
    """Encodes chunks with the tokenizers library, each distinct pre-token once.

    Pre-tokens of letters go to the library many in one text and are told apart in its ids: byte-level ones begin
    with a blank, word-level ones end with a token that ends a word. Chunks with rarer characters go to it whole.
    """

    def __init__(self, path: str, limit: int = 100_000):
        from tokenizers import Tokenizer

        self.library, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.lower = any(t.endswith("</w>") for t in vocabulary)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if self.lower else token.startswith("Ġ")
        self.line = None if self.lower else vocabulary.get("Ċ")
        self.pattern, self.letters = (WORD_LEVEL, PLAIN_LETTERS) if self.lower else (BYTE_LEVEL, SPACED_LETTERS)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, fresh: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of pre-tokens to known."""
        batch = [x for x in fresh if self.letters.fullmatch(x)]
        if self.line is not None:  # letters without a blank, a line feed before each
            plain = [x for x in fresh if PLAIN_LETTERS.fullmatch(x)]
            for i in range(0, len(plain), 500):
                some = plain[i : i + 500]
                ids = self.whole("\n" + "\n".join(some))
                cuts = [*(4 * np.flatnonzero(ids == self.line)).tolist(), 4 * len(ids)]
                ids = ids.tobytes()
                known.update(zip(some, (ids[a + 4 : b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
            fresh = set(fresh).difference(plain)
        for i in range(0, len(batch), 500):
            some = batch[i : i + 500]
            ids = self.whole((" " if self.lower else "").join(some))
            edges = np.flatnonzero(self.edge[ids])
            cuts = [0, *(4 * (edges + 1)).tolist()] if self.lower else [*(4 * edges).tolist(), 4 * len(ids)]
            ids = ids.tobytes()
            known.update(zip(some, map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        known.update((x, self.whole(x).tobytes()) for x in set(fresh).difference(batch))

    def tokenise(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        alone, parts = set(), {}
        for c in chunks:
            if self.letters.fullmatch(c) and not (self.lower and not c.islower()):
                alone.add(c)
            elif LATIN.fullmatch(c) and LATIN.fullmatch(low := c.lower() if self.lower else c) and not ("<|" in c and any(s in c for s in self.special)):
                parts[c] = self.pattern.findall(low)  # 23 capitals of LATIN have lower-case forms outside of it
        known, single = self.known, {}
        self.learn(list({x for own in parts.values() for x in own}.difference(known)), known)
        self.learn(list(alone), single)  # the table remembers these
        return [single[c] if c in single else b"".join(map(known.__getitem__, parts[c])) if c in parts else self.whole(c).tobytes() for c in chunks]


_TABLES: dict[tuple, ChunkTable] = {}


def table_for(kind: str, path: str, limit: int = 400_000) -> ChunkTable:
    """This worker's table for a tokenizer file."""
    if (key := (kind, path)) not in _TABLES:
        if kind == "sentencepiece":
            from lexisift.llm.sentencepiece_codec import PieceModel

            _TABLES[key] = ChunkTable(PieceModel(path).tokenise)
        else:
            encoder = PreTokenEncoder(path)
            _TABLES[key] = ChunkTable(encoder.tokenise, limit, max(encoder.library.get_vocab().values()))
    return _TABLES[key]
