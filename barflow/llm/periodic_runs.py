"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of consecutive words whose smallest period is ``q`` (words
``q`` apart are identical), at least ``max(min_length, 2 * q)`` words long, that
no neighbouring word extends with period ``q``.

The words of a text are read once, from left to right. Word ``i`` and an earlier
occurrence ``i - p`` lie on the diagonal of lag ``p``; each active lag holds its
match length, which grows with every further match. A diagonal that ends with
sufficient length is emitted at once. Three facts keep the DP sparse; none of
them drops a run:

* A run of lag ``p`` has at least ``max(p, min_length - p)`` matches. So a lag of
  ``[l, 2 * l)`` becomes active only where the ``l`` words from here equal the
  ``l`` words from the earlier place (``l`` is a base length times a power of two,
  words ahead are compared by hash), and earlier places further back are not
  looked at.
* A diagonal begins only where the words before both places differ.
* A lag that is a multiple of an active lag with a full period matched, and whose
  stretch begins at the same word, has that smaller period for good.

So the work of a text of ``n`` words is about ``n log n`` even if all of them are
equal, and texts without such places are never walked through.

NULL text counts as empty (no words, no runs). Repeated rows and NULL ids are
rows like others. Empty input gives an empty result. Only id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import WORD, ship, text_or_empty
from barflow.llm.packing import steps

MIN_LENGTH = 12
#: Bytes of text taken at a time.
STEP_BYTES = 4_000_000
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Odd 64-bit multipliers of the hashes of words ahead.
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Places of a text where a diagonal may begin: {word number: [(level, group)]}.
Places = dict[int, list[tuple[int, int]]]


def diagonal_starts(words: np.ndarray, ends: np.ndarray, base: int) -> dict[int, Places]:
    """Per text, the places where the next ``base * 2 ** level`` words recur less than
    twice as many words away behind another word. ``words`` are the word numbers of all
    texts one after another, ``ends`` the position behind each text."""
    n = len(words)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    left = ends[doc] - np.arange(n)  # words from here to the end of the text
    first = np.zeros(n, dtype=bool)
    first[(ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]] = True
    before = np.where(first, -1, np.concatenate([[-1], words[:-1]])) if n else words
    own = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(29)
    ahead = np.zeros(n, dtype=np.uint64)
    for k in range(base):
        ahead[:n - k] += own[k:] * (_STEP ** np.uint64(k + 1) if k else _STEP)
    at, length, level, out = np.flatnonzero(left >= base), base, 0, {}
    while len(at):
        key = ahead[at] ^ (doc[at].astype(np.uint64) * _MIX)
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same = (key[1:] == key[:-1]) & (doc[place[1:]] == doc[place[:-1]])
        near = same & (place[1:] - place[:-1] < 2 * length)
        group = np.cumsum(np.concatenate([[True], ~near]))
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[1:][near & (before[place[1:]] != before[place[:-1]])]] = True
        chosen = np.flatnonzero(mixed[group])
        for x, g in zip(place[chosen].tolist(), group[chosen].tolist(), strict=True):
            out.setdefault(int(doc[x]), {}).setdefault(x, []).append((level, g))
        # Longer stretches recur only where these do.
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        at = np.sort(place[again])
        at = at[left[at] >= 2 * length]
        longer = np.zeros(n, dtype=np.uint64)
        longer[at] = ahead[at] * _STEP + (ahead[at + length] ^ (ahead[at + length] >> np.uint64(31))) * _MIX
        # A place without a hash of its own half further on cannot recur either.
        ahead, length, level = longer, 2 * length, level + 1
    starts = ends - np.diff(ends, prepend=0)
    return {d: {x - int(starts[d]): v for x, v in places.items()} for d, places in out.items()}


def find_runs(words: list[int], places: Places, base: int, min_length: int) -> list[tuple[int, int, int]]:
    """The online pass over one text: ``(start, length, period)`` of its runs, by start and period."""
    out, n = [], len(words)
    active: dict[int, int] = {}  # lag -> first word of its stretch
    seen: dict[tuple[int, int], dict[int, list[int]]] = {}
    order = sorted(places)
    nxt, i = 0, 0
    while True:
        if not active:
            if nxt == len(order):
                break
            i = order[nxt]
        ended = [p for p in active if i == n or words[i] != words[i - p]]
        for p in ended:
            start = active.pop(p)
            if i - start >= max(min_length, 2 * p):
                out.append((start, i - start, p))
        if i == n:
            break
        if nxt < len(order) and order[nxt] == i:
            nxt += 1
            before = words[i - 1] if i else -1
            for level, group in places[i]:
                least, most = (base << level) if level else 1, base << (level + 1)
                earlier = seen.setdefault((level, group), {})
                for other, where in earlier.items():
                    if other == before:
                        continue
                    for j in reversed(where):
                        p = i - j
                        if p >= most:
                            break
                        if p < least or words[i] != words[j]:
                            continue
                        if not any(s == j and p % q == 0 and i - s >= 2 * q for q, s in active.items()):
                            active[p] = j
                earlier.setdefault(before, []).append(i)
        i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period:start + length] = bytes(length - period)
    return list(compress(words, keep))


def runs_of_texts(texts: list[bytes], min_length: int = MIN_LENGTH) -> tuple[list[int], list[list], list[bytes]]:
    """Number of words, runs and collapsed text of every text. Words are separated by ASCII white space."""
    base = max(1, -(-min_length // 2))
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in split]
    sizes = [len(c) for c in coded]
    ends = np.cumsum(sizes)
    flat = np.fromiter((x for c in coded for x in c), dtype=np.int64, count=int(ends[-1]) if sizes else 0)
    starts = diagonal_starts(flat, ends, base)
    runs = [find_runs(coded[d], starts[d], base, min_length) if d in starts else [] for d in range(len(texts))]
    return sizes, runs, [b" ".join(collapse(w, r)) for w, r in zip(split, runs, strict=True)]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``. ``runs`` holds every run's
    start, length and period by start, then period; ``collapsed`` the words outside the
    repeated periods, joined by one space. Nothing is shuffled."""
    ship(docs.sparkSession)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw in steps(batch.column(0), batch.column(1), STEP_BYTES):
                sizes, runs, texts = runs_of_texts(raw, min_length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], _RUNS),
                    pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(detect, SCHEMA)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` in which about a tenth of the texts end in a repeated stretch: with
    ``h = crc32(id)`` (a NULL id counts as empty text), ``g = h div 10`` and ``n`` words, where
    ``h % 10 = 0`` every word ``i >= a`` becomes word ``a + (i - a) % p``, with ``a = g % n`` and
    ``p = 1 + (n - a) div (3 + g % 8)``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))) \
         .withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")) \
         .withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int"))

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))

    made = F.array_join(F.transform("words", word), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
