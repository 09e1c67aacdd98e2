"""Encoding and decoding with a sentence-piece model through a table of distinct chunks.

Where no piece of the model holds a whitespace marker after another character, no
merge crosses the start of a marked word (a run of markers and what follows it up to
the next marker). So each distinct marked word is segmented once, by the library, and
a text's ids are the table's entries joined by position. The same holds for decoding:
a chunk decodes to its text without the first marker, which is the space between chunks.

The tables live in the Python workers and are emptied at ``TABLE_ENTRIES`` entries;
chunks over ``LONG`` bytes are segmented each time. Nothing is shuffled, so hot sources
and copies cost nothing and a lost executor repeats its tasks only.

Null and empty texts have no ids and decode to the empty text; repeated rows each get
their own result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import add_columns, tokenizer_file

MODEL = "piece_bpe_32k.model"
TABLE_ENTRIES, LONG = 250_000, 64
_MARK, _RUN = "▁".encode(), re.compile(rb" +[^ ]*")
_workers: dict[str, ChunkTable] = {}


class ChunkTable:
    """Distinct marked words of one model: chunk -> (ids as bytes, ids as text, decoded text)."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for i in range(self.sp.get_piece_size()) if "▁" in (p := self.sp.id_to_piece(i)).lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.alone = self.sp.piece_to_id("▁")
        self.table: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    def segment(self, chunks: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        ids = self.sp.encode([c.decode("utf-8", "replace") for c in chunks], num_threads=1)
        ids = [x or [self.alone] for x in ids]  # only the lone marker has an empty remainder
        texts = self.sp.decode(ids, num_threads=1)
        return [(array("i", i).tobytes(), ",".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, texts)]

    def chunks(self, text: bytes) -> list[bytes]:
        """Marked words without their first marker; the library's own leading marker counts."""
        if not text:
            return []
        if _MARK in text:
            text = text.replace(_MARK, b" ")
        if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return [m[1:] for m in _RUN.findall(b" " + text)]
        return text.split(b" ")

    def rows(self, texts: list[bytes]) -> list[list[tuple[bytes, bytes, bytes]]]:
        parts = [self.chunks(t) for t in texts]
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        seen = set().union(*parts)
        new = [c for c in seen if c not in self.table]
        entry = dict(zip(new, self.segment(new)))
        self.table.update((c, e) for c, e in entry.items() if len(c) <= LONG)
        at = self.table
        return [[at[c] if c in at else entry[c] for c in p] for p in parts]


def table_of(model: str) -> ChunkTable:
    if model not in _workers:
        _workers[model] = ChunkTable(model)
    return _workers[model]


def encode(docs: DataFrame, keep: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """``keep`` plus ``ids`` (array of int) and ``decoded`` (string) of every row."""
    path = model or tokenizer_file(MODEL)

    def make():
        table = table_of(path)

        def work(texts):
            rows = table.rows(texts)
            flat = [b"".join([i for i, _, _ in r]) for r in rows]
            ends = np.cumsum([0, *(len(f) // 4 for f in flat)], dtype=np.int32)
            return {
                "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), np.int32))),
                "decoded": [b" ".join(d for _, _, d in r).decode() for r in rows],
            }

        return work

    return add_columns(docs, keep, "ids array<int>, decoded string", make, text)


def digests(docs: DataFrame, keep: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """``keep`` plus ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, without building id lists."""
    path = model or tokenizer_file(MODEL)

    def make():
        table = table_of(path)

        def work(texts):
            rows = table.rows(texts)
            return {
                "n_tokens": [sum([len(i) for i, _, _ in r]) // 4 for r in rows],
                "ids_sha256": [sha256(b",".join([s for _, s, _ in r])).hexdigest() for r in rows],
                "decoded_sha256": [sha256(b" ".join([d for _, _, d in r])).hexdigest() for r in rows],
            }

        return work

    return add_columns(docs, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, text)
