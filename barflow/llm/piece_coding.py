"""SentencePiece encoding and decoding through a table of distinct chunks.

A text becomes ``▁`` plus itself with spaces as ``▁``. In a vocabulary in which no
piece holds the marker behind another character, no piece reaches over the place
between a word and the next marker, so a text falls into chunks, each a run of
markers and the word behind it, that are segmented on their own. Every distinct
chunk is segmented and decoded once and kept in a table (per Python worker, up to
``KEPT_CHUNKS`` chunks, then afresh); the texts' chunk numbers are joined to the
table's ids by position. A vocabulary with other pieces is refused.

NULL text counts as empty: no ids, empty decoded text. Repeated rows and NULL ids
are rows like others. Empty input gives an empty result. Only id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import ship, text_or_empty
from barflow.llm.packing import steps

#: Distinct chunks, and characters of them, that a Python worker keeps at once.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 40_000_000
#: Bytes of text coded at a time.
STEP_BYTES = 4_000_000
MARKER = "▁"
#: A run of markers (as spaces) and the word behind it.
CHUNK = re.compile(" +[^ ]*")
SCHEMA = "doc_id bigint, ids array<int>, decoded string"


class ChunkTable:
    """Ids and decoded text of every distinct chunk seen."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        from sentencepiece import SentencePieceProcessor
        self.model, self.kept = SentencePieceProcessor(model_file=path), kept
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crossing = next((p for p in pieces if MARKER in p.lstrip(MARKER)), None)
        if crossing is not None:
            raise ValueError(f"pieces cross white-space markers: {crossing!r}")
        if self.model.decode(self.model.encode("  a  b ")) != "  a  b ":
            raise ValueError("the model does not keep white space")
        self.lone = self.model.piece_to_id(MARKER)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.decoded: list[str] = []
        self.chars = 0

    def _segment(self, chunks: list[str]) -> None:
        # The library puts a marker before a text itself, so a chunk goes without its first one; a
        # marker alone would be an empty text, which the library leaves empty.
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x if len(c) > 1 else [self.lone] for c, x in zip(chunks, ids, strict=True)]
        self.decoded += [" " + t for t in self.model.decode(ids, num_threads=1)]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(counts.sum()))])
        self.starts = np.concatenate([self.starts, at + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.chars += sum(map(len, chunks))

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids one after another, the position where each text's ids begin (one more at the end),
        and the decoded texts."""
        if len(self.numbers) > self.kept or self.chars > KEPT_CHARS:
            self._clear()
        numbers, fresh, rows = self.numbers, [], []
        for t in texts:
            row = []
            for c in CHUNK.findall(" " + t.replace(MARKER, " ")) if t else ():
                k = numbers.get(c)
                if k is None:
                    k = numbers[c] = len(numbers)
                    fresh.append(c)
                row.append(k)
            rows.append(row)
        if fresh:
            self._segment(fresh)
        size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        own = np.fromiter((k for row in rows for k in row), dtype=np.int64, count=int(size.sum()))
        n = self.counts[own]
        ids = self.flat[np.repeat(self.starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(size)])]
        decoded = self.decoded
        return ids, ends, ["".join([decoded[k] for k in row])[1:] for row in rows]


_TABLES: dict[str, ChunkTable] = {}


def _table(path: str) -> ChunkTable:
    """One table per Python worker, kept from task to task."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def piece_coding(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids, decoded``, as the sentencepiece library encodes the
    whole text (no begin or end ids, no sampling) and decodes its ids. Nothing is shuffled."""
    ship(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for batch in batches:
            for own, raw in steps(batch.column(0), batch.column(1), STEP_BYTES):
                ids, ends, decoded = table.code([t.decode("utf-8", "replace") for t in raw])
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(code, SCHEMA)
