"""Best-two-fit packing of token sequences.

A document is its token ids plus an end id. Only documents longer than the
capacity are cut, into pieces of the capacity (the last may be shorter). Full
pieces are sequences of their own; the others are dealt by hash into chunks of
a bounded number of pieces, and each chunk is packed by best-two-fit.

NULL text counts as empty (its sequence is the end id alone); repeated rows
and repeated or NULL ids are separate documents. Empty input gives an empty
result. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut, kept, ship, text_or_empty

#: Pieces that one packing task holds; a chunk leaves a few open sequences at most.
CHUNK_PIECES = 16_384
#: Words whose ids a Python worker keeps at once.
KEPT_WORDS = 600_000
#: Bytes of text encoded at a time.
STEP_BYTES = 4_000_000
#: Rows taken out of an Arrow batch at a time.
STEP_ROWS = 256

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: the byte's own
    Latin-1 character if it is visible, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Token ids of texts for a tokenizer that drops white space.

    ASCII white space always separates words for such a tokenizer, so each
    distinct word is encoded once by the library and its ids are kept (up to
    ``kept`` words, then afresh). The ids equal those of the whole text."""

    def __init__(self, path: str, end_id: int, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.end_id, self.kept = end_id, kept
        self.signs = {c: self.tokenizer.encode(chr(c), add_special_tokens=False).ids for c in b".,"}
        self.chars = byte_characters()
        self._clear()

    def _clear(self) -> None:
        outer = self

        class Numbers(dict):
            def __missing__(self, word):
                n = len(self)
                self[word] = n
                outer.pending.append(word)
                return n

        self.pending: list[bytes] = []
        self.numbers = Numbers()
        self.numbers[None] = 0  # stands for the end of a document
        self.flat = np.array([self.end_id], dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.counts = np.ones(1, dtype=np.int64)

    def _encode_pending(self) -> None:
        if not self.pending:
            return
        ids = list(map(self._letters, self.pending))
        rest = [i for i, x in enumerate(ids) if x is None]
        got = self.tokenizer.encode_batch_fast([self.pending[i].decode("utf-8", "replace") for i in rest],
                                               add_special_tokens=False)
        for i, e in zip(rest, got, strict=True):
            ids[i] = e.ids
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), dtype=np.uint32,
                                                           count=int(counts.sum()))])
        self.starts = np.concatenate([self.starts, at + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.pending = []

    def _letters(self, word: bytes) -> list[int] | None:
        """Ids of a word of letters, with one full stop or comma behind it or none: normalising
        leaves such a word as it is (ASCII capitals fold) and it is one pre-token, so the
        library's model alone gives its ids. None for any other word."""
        sign = self.signs.get(word[-1])
        if sign is not None:
            word = word[:-1]
        if word.isalpha():
            plain = word.lower().decode()
        else:
            text = word.decode("utf-8", "replace")
            if not text.isalpha() or text != text.lower() or not unicodedata.is_normalized("NFC", text):
                return None
            plain = "".join([self.chars[b] for b in word])
        return [t.id for t in self.model.tokenize(plain)] + (sign or [])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the position where each text's ids begin (one more at the end)."""
        if len(self.numbers) > self.kept:
            self._clear()
        number, words = self.numbers.__getitem__, []
        ends = np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            words.extend(map(number, t.split()))
            words.append(0)
            ends[i] = len(words)
        self._encode_pending()
        w = np.array(words, dtype=np.int64)
        counts = self.counts[w]
        total = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[w] - (total - counts), counts) + np.arange(total[-1] if len(w) else 0)]
        return ids, np.concatenate([[0], total[ends - 1]]) if len(texts) else np.zeros(1, dtype=np.int64)


def _encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    return kept(("words", path, end_id), lambda: WordEncoder(path, end_id))


def steps(ids: pa.Array, texts: pa.Array, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts in runs of about ``most`` bytes; only a run is copied out of the batch."""
    own, run, size = [], [], 0
    for at in range(0, len(texts), STEP_ROWS):
        part = texts.slice(at, STEP_ROWS).cast(pa.large_binary())
        for i, t in zip(ids.slice(at, STEP_ROWS), part, strict=True):
            own.append(i.as_py())
            run.append(t.as_py())
            size += len(run[-1])
            if size >= most:
                yield own, run
                own, run, size = [], [], 0
    if run:
        yield own, run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids (unsigned little-endian
    32-bit) of every document and its end id, cut at the capacity."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, end_id)
        for batch in batches:
            for own, texts in steps(batch.column(0), batch.column(1), STEP_BYTES):
                ids, at = encoder.encode(texts)
                ids = ids.astype("<u4")
                n = np.diff(at)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                first = (at[:-1][doc] + start) * 4
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[i] for i in doc], pa.int64()), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(first.tolist(), (first + length * 4).tolist(), strict=True)], pa.binary()),
                ], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(pieces, PIECE_SCHEMA)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. A bin takes the longest item that fits, again
    and again; then its smallest item gives way to the two unpacked items whose
    sum fills the space best, if they fill more than it did."""
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    mask = sum(1 << n for n, c in enumerate(count) if c)  # lengths at hand
    back = sum(1 << (capacity - n) for n, c in enumerate(count) if c)  # the same, mirrored
    flat: list[int] = []
    bins: list[int] = []

    def change(n: int, by: int) -> None:
        nonlocal mask, back
        had, count[n] = count[n], count[n] + by
        if not had or not count[n]:
            mask ^= 1 << n
            back ^= 1 << (capacity - n)

    def pair(low: int, high: int) -> tuple[int, int] | None:
        """Two items at hand with the largest sum in (low, high]."""
        if not mask or 2 * ((mask & -mask).bit_length() - 1) > high:
            return None
        for total in range(high, low, -1):
            hits = mask & (back >> (capacity - total))
            while hits:
                a = hits.bit_length() - 1
                if 2 * a != total or count[a] > 1:
                    return a, total - a
                hits ^= 1 << a
        return None

    while mask:
        gap, own = capacity, []
        while fits := mask & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            k = min(count[n], gap // n)
            change(n, -k)
            own += [n] * k
            gap -= n * k
        if gap and len(own) > 1 and (two := pair(own[-1], gap + own[-1])):
            change(own.pop(), 1)
            for n in two:
                change(n, -1)
                own.append(n)
        flat += own
        bins += [len(own)]
    packed = np.array(flat, dtype=np.int64)
    per = np.array(bins, dtype=np.int64)
    at = np.cumsum(packed) - packed
    offset = at - np.repeat(at[np.cumsum(per) - per], per) if len(per) else at
    item = np.argsort(packed, kind="stable")
    order = np.argsort(lengths, kind="stable")
    out_bin, out_offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    out_bin[order] = np.repeat(np.arange(len(per)), per)[item]
    out_offset[order] = offset[item]
    return out_bin, out_offset


def place(pieces: DataFrame, capacity: int = 2048, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """``uid, sequence_id, offset`` of written pieces with columns ``uid`` (unique) and ``length``."""
    ship(pieces.sparkSession)
    rows = pieces.where(F.col("length") < capacity).count()
    chunks = max(1, -(-rows // chunk_pieces))
    full = pieces.where(F.col("length") >= capacity).select(
        "uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack(pdf):
        pdf = pdf.sort_values("uid", ignore_index=True)
        bins, offset = best_two_fit(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (int(pdf["chunk"].iloc[0]) << 32) + bins
        pdf["offset"] = offset
        return pdf[["uid", "sequence_id", "offset"]]

    open_ = (pieces.where(F.col("length") < capacity)
             .select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk"))
             .groupBy("chunk").applyInPandas(pack, "uid bigint, sequence_id bigint, offset bigint"))
    return full.unionByName(open_)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """The pieces (any columns besides ``length``, written once) with ``sequence_id`` and ``offset``."""
    kept = cut(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    return kept.join(place(kept, capacity, chunk_pieces), "uid").drop("uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed sequences with their token ids: one row per piece."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
