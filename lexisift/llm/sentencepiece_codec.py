"""SentencePiece encoding and decoding by a distinct-chunk table.

A model's pieces may hold the white-space marker only as their first characters; then no piece crosses from a
word into the marker that follows, and a text's ids are those of its marked words, one after the other. That
property is checked on the model's pieces; a model without it is encoded text by text with the library itself. Line feeds
are cut off as well where no piece holds one.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexisift.llm.chunk_table import ChunkTable, table_for
from lexisift.llm.common import keyed, map_texts

MARK = "▁"


class PieceModel:
    """A sentencepiece model and where its texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.pieces = {self.library.id_to_piece(i): i for i in plain}
        probe = "  a  b\t c ﬁ Å  "
        same = self.library.normalize(probe) == (MARK + probe).replace(" ", MARK)
        self.lines = same and not any("\n" in p for p in self.pieces)
        self.cuts = same and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.pattern = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lines else f"{MARK}+[^{MARK}]*")

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text, and its line feeds."""
        if not text:
            return []
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if self.cuts else [MARK + text]

    def tokenise(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. The library puts a marker before each text: a chunk that has one goes without, one
        that has none goes behind a line feed, whose ids and the marker's are taken off."""
        line = self.library.encode("\n")
        ids = self.library.encode([c[1:] if c[0] == MARK and len(c) > 1 else "\n" + c for c in chunks], num_threads=1)
        return [array("I", own if c[0] == MARK and len(c) > 1 else own[len(line) :]).tobytes() for c, own in zip(chunks, ids, strict=True)]


_MODELS: dict[str, PieceModel] = {}


def model_for(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(path: str, texts: list[str]) -> tuple[ChunkTable, np.ndarray, np.ndarray, np.ndarray]:
    """The table, all ids, where each text's begin, all chunks' codes."""
    table = table_for("sentencepiece", path)
    return table, *table.encode([model_for(path).chunks(x) for x in texts])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document, as the library encodes it without begin, end and sampling.

    Null and empty texts have no ids. Rows that repeat, or share an id, each have a result; order does not matter.
    An empty table gives an empty one.
    """

    def step(ids: pa.Array, texts: list[str]) -> dict:
        _, flat, starts, _ = encode_texts(path, texts)
        return {"doc_id": ids, "ids": pa.ListArray.from_arrays(starts.astype(np.int32), flat.astype(np.int32))}

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids, by the library's decode(ids). Null ids give the empty text."""

    def run(batches):
        library = model_for(path).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(library.decode([x or [] for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {dict(encoded.dtypes)[id_col]}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every document in one pass; the digests of its ids and of the decoded text. Cases as in encode();
    whole texts are read however long, other columns are not."""

    def step(ids: pa.Array, texts: list[str]) -> dict:
        library = model_for(path).library
        _, flat, starts, _ = encode_texts(path, texts)
        own = [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return {
            "doc_id": ids,
            "n_tokens": np.diff(starts),
            "ids_sha256": [hashlib.sha256(repr(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in own],
            "decoded_sha256": [hashlib.sha256(library.decode(x).encode("utf-8", "replace") if x else b"").hexdigest() for x in own],
        }

    return map_texts(keyed(docs, id_col, text_col), step, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
