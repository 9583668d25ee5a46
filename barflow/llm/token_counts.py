"""Token counts: pieces are counted once per distinct pre-token, joined to each
document's pre-token frequencies and summed; no token ids are kept.

NULL text counts as empty: 0 bytes, 0 tokens. Repeated rows and repeated or
NULL ids are separate documents. Empty input gives an empty result. Only id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut, ship, text_or_empty
from barflow.llm.packing import byte_characters, steps

#: The most frequent pre-tokens, and their longest size in bytes, that go to every task with
#: their counts (16 MB at most); all others are joined.
HOT_PRETOKENS, HOT_BYTES = 1 << 17, 64
#: Distinct words a Python worker keeps, or a task counts before it passes them on.
KEPT_WORDS = 600_000
STEP_BYTES = 4_000_000
ROWS = 100_000

#: The pre-token pattern of byte-level BPE, and its white space.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Characters for which the pattern and the library certainly agree; texts with others go through the library.
PLAIN = r"[^\t-\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u20ac]"


class PreTokens:
    """Splits texts as the tokenizer's own pre-tokenizer does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find, self.odd = regex.compile(PATTERN).findall, regex.compile(PLAIN).search
        self.model, self.chars = self.tokenizer.model, byte_characters()

    def split(self, text: str) -> list[str]:
        if self.odd(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def keys(self, text: str) -> tuple[list, int]:
        """What :meth:`of_key` turns into the pre-tokens of a whole text, and its number of special tokens.

        A single space always begins a pre-token, so a run between single spaces is
        split on its own: such a run is its own key. ``("", run)`` has no space before
        it, ``(p,)`` is a pre-token already."""
        parts = self.special.split(text) if self.special else [text]
        out: list = []
        for part in parts:
            if "  " in part:
                out += [(p,) for p in self.split(part)]
            elif part:
                runs = part.split(" ")
                out.append(("", runs[0]))
                out += runs[1:]
        return out, len(parts) - 1

    def of_key(self, key) -> list[str]:
        if isinstance(key, str):
            return [" " + key] if key.isascii() and key.isalpha() else self.split(" " + key)
        return [key[0]] if len(key) == 1 else self.split(key[1])

    def n_pieces(self, pretoken: str) -> int:
        return len(self.model.tokenize("".join([self.chars[b] for b in pretoken.encode()])))


class Numbered(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.pending: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.pending.append(key)
        return n


class Frequencies:
    """Splits the pre-tokens of texts into a sum of known counts and frequencies of the others."""

    def __init__(self, pre: PreTokens, known: dict[str, int]):
        self.pre, self.known = pre, known
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.names, self.name_numbers = Numbered(), [], {}
        self.sums = np.zeros(0, dtype=np.int64)
        self.starts, self.counts, self.flat = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _resolve(self) -> None:
        sums, counts, flat = [], [], []
        for key in self.numbers.pending:
            total = n = 0
            for p in self.pre.of_key(key):
                c = self.known.get(p)
                if c is not None:
                    total += c
                    continue
                i = self.name_numbers.get(p)
                if i is None:
                    i = self.name_numbers[p] = len(self.names)
                    self.names.append(p)
                flat.append(i)
                n += 1
            sums.append(total)
            counts.append(n)
        self.numbers.pending = []
        at, c = len(self.flat), np.array(counts, dtype=np.int64)
        self.sums = np.concatenate([self.sums, np.array(sums, dtype=np.int64)])
        self.starts = np.concatenate([self.starts, at + np.cumsum(c) - c])
        self.counts = np.concatenate([self.counts, c])
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.int64)])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Per text the sum of known counts and special tokens; the others as (text, pre-token, frequency)."""
        if len(self.numbers) > KEPT_WORDS:
            self._clear()
        number, keys = self.numbers.__getitem__, []
        ends, special = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own, special[i] = self.pre.keys(t)
            keys.extend(map(number, own))
            ends[i] = len(keys)
        self._resolve()
        k = np.array(keys, dtype=np.int64)
        size = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(texts)), size)
        base = np.concatenate([[0], np.cumsum(self.sums[k])])
        base = base[ends] - base[ends - size] + special
        cold = self.counts[k] > 0
        doc, k = doc[cold], k[cold]
        c = self.counts[k]
        pos = np.repeat(self.starts[k] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both, freq = np.unique(np.repeat(doc, c) * len(self.names) + self.flat[pos], return_counts=True)
        names = self.names
        return base, both // max(len(names), 1), [names[i] for i in (both % max(len(names), 1)).tolist()], freq


_SPLITTERS: dict[str, PreTokens] = {}


def _splitter(path: str) -> PreTokens:
    """One splitter per Python worker, kept from task to task."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = PreTokens(path)
    return _SPLITTERS[path]


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``pretoken, freq, n_pieces`` of all distinct pre-tokens of all texts, written once."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, total = _splitter(tokenizer_path), Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(pre.keys(t.as_py())[0])
                if len(total) > KEPT_WORDS:
                    yield from _pairs(pre, total)
                    total = Counter()
        yield from _pairs(pre, total)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_pieces = _splitter(tokenizer_path).n_pieces
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              pa.array(list(map(n_pieces, batch.column(0).to_pylist())), pa.int64())],
                                             names=["pretoken", "freq", "n_pieces"])

    seen = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "pretoken string, freq bigint")
    all_ = seen.groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return cut(all_.mapInArrow(pieces, "pretoken string, freq bigint, n_pieces bigint"), "pretokens")


def _pairs(pre: PreTokens, keys: Counter) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for key, n in keys.items():
        for p in pre.of_key(key):
            total[p] += n
    names, values = list(total), list(total.values())
    for i in range(0, len(names), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(names[i:i + ROWS], pa.string()), pa.array(values[i:i + ROWS], pa.int64())],
                                         names=["pretoken", "freq"])


def _hot(words: DataFrame, most: int) -> dict[str, int]:
    """Pieces of at most ``most`` of the most frequent pre-tokens: all whose frequency
    reaches a bound, which is found from a histogram of at most 512 classes."""
    short = words.where(F.octet_length("pretoken") <= HOT_BYTES).withColumn("level", F.floor(8 * F.log2("freq")))
    bound, total = 0, 0
    for level, n in sorted(short.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most:
            bound = level + 1
            break
    return {r[0]: r[1] for r in short.where(F.col("level") >= bound).select("pretoken", "n_pieces").toLocalIterator()}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 hot_pretokens: int = HOT_PRETOKENS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens``.

    The counts of the ``hot_pretokens`` most frequent pre-tokens (a bounded
    table) go to every task, so no frequent key is shuffled; each document's
    other pre-tokens are joined to the vocabulary, a row per distinct one."""
    spark = docs.sparkSession
    words = vocabulary(docs, tokenizer_path, text_col)
    hot = spark.sparkContext.broadcast(_hot(words, hot_pretokens))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(_splitter(tokenizer_path), hot.value)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for own, raw in steps(batch.column(0), batch.column(1), STEP_BYTES):
                base, doc, names, f = freq.of([t.decode() for t in raw])
                yield _rows(np.arange(uid, uid + len(own)), own, [len(t) for t in raw], base, doc, names, f)
                uid += len(own)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(frequencies, ROW_SCHEMA)
    # A document's own row gets a key that no pre-token equals, so that these rows spread evenly.
    key = F.coalesce("pretoken", F.concat(F.lit("\0"), F.col("uid").cast("string")))
    joined = rows.withColumn("key", key).join(words.select(F.col("pretoken").alias("key"), "n_pieces"), "key", "left")
    return joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce(F.col("base"), F.col("freq") * F.col("n_pieces"))).alias("n_tokens")).drop("uid")


ROW_SCHEMA = "uid bigint, doc_id bigint, n_bytes bigint, base bigint, pretoken string, freq bigint"


def _rows(uid: np.ndarray, ids: list, sizes: list[int], base: np.ndarray, doc: np.ndarray, names: list[str],
          freq: np.ndarray) -> pa.RecordBatch:
    """A row for each document, then one for each of its other pre-tokens."""
    n, m = len(uid), len(doc)
    none = pa.nulls(m, pa.int64())
    join = lambda a, b: pa.concat_arrays([a, b])
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([uid, uid[doc]])), join(pa.array(ids, pa.int64()), none),
        join(pa.array(sizes, pa.int64()), none), join(pa.array(base, pa.int64()), none),
        join(pa.nulls(n, pa.string()), pa.array(names, pa.string())),
        join(pa.nulls(n, pa.int64()), pa.array(freq, pa.int64())),
    ], names=["uid", "doc_id", "n_bytes", "base", "pretoken", "freq"])
