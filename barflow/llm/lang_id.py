"""Language identification by cross-parsing entropy.

Labelled text of each language is indexed by a suffix automaton. A text is
parsed greedily into the longest phrases that occur in the language's labelled
text; the language that needs the fewest phrases, normalised to
``phrases * log2(labelled characters) / characters`` (the cross-parsing
estimate of the entropy per character, with the largest language's number of
labelled characters for all), wins. Ties go to the smaller name.

Only letters count: case is folded, any run of other characters is one space.
Texts are read whole, in segments of ``SEGMENT`` characters at whose ends a
phrase ends; all segments of a batch step through the automata together.

NULL text and text without a letter get ``und`` with score 0, as does every
text if nothing was learned. Repeated rows and NULL ids are rows like others.
Empty input gives an empty result. Only the named columns are read, so other
columns may have any name.

The automata are fitted on a bounded sample: per language the ``SAMPLE_TEXTS``
distinct labelled texts with the smallest content hash, of each the ``SAMPLE_CHARS``
characters that begin at a place chosen by its hash anywhere in the whole text (all of a
shorter one). So an opening that many texts share is not what is learned.

Transitions are kept in a hash table of their own number, about three a character of the
sample, whatever the number of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import kept, ship

SAMPLE_TEXTS, SAMPLE_CHARS = 64, 400
SEGMENT = 256
#: Rows of a batch, and characters of text, that go through the automata at a time.
STEP_ROWS, STEP_CHARS = 1000, 2_000_000
UNDETERMINED = "und"
#: Samples of one language without name or text: with them :func:`identify` gives every text with letters that name.
UNLABELLED = (("", ("",)),)
#: Classes of characters: space, a letter outside all samples, the join between sample texts.
GAP, OTHER, JOIN, FIRST = 0, 1, 2, 3


class Models:
    """One automaton per language over a common alphabet of character classes."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        letters = np.zeros(0x110000, dtype=bool)
        letters[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        self.languages = [name for name, _ in samples]
        low = sorted({c for _, texts in samples for t in texts for c in t.lower() if c.isalpha()})
        number = {c: FIRST + i for i, c in enumerate(low)}
        self.classes = np.full(0x110000, GAP, dtype=np.int32)
        self.classes[letters] = OTHER
        for c, k in number.items():
            self.classes[ord(c)] = k
            if len(c.upper()) == 1 and c.upper().lower() == c:
                self.classes[ord(c.upper())] = k
        self.width = FIRST + len(low)
        self.tables, sizes = [], [2]
        for _, texts in samples:
            parts = [self.encode(t)[0] for t in texts]
            own = np.concatenate([x for p in parts for x in (p, [JOIN])]) if parts else np.array([JOIN])
            self.tables.append(Automaton(own.tolist(), self.width))
            sizes.append(sum(map(len, parts)))
        # One weight for all: with its own, a language of hardly any labelled text would seem to fit everything.
        self.weight = np.log2(max(sizes))

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Character classes with runs of non-letters as one space, and whether there is a letter."""
        c = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        gap = c == GAP
        keep = ~gap
        keep[:1] = True
        keep[1:] |= ~gap[:-1]
        return c[keep], not gap.all()

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrase counts (texts by languages), and which texts have letters."""
        parts = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c, _ in parts])
        some = np.array([x for _, x in parts], dtype=bool)
        n = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + first * SEGMENT
        length = np.minimum(SEGMENT, sizes[doc] - first * SEGMENT)
        flat = np.concatenate([c for c, _ in parts] + [np.zeros(SEGMENT, dtype=np.int32)])
        order = np.argsort(-length, kind="stable")  # segments that have ended drop off the end
        at, length = at[order], length[order]
        alive = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
        out = np.zeros((len(texts), len(self.languages)))
        for k, table in enumerate(self.tables):
            state = np.zeros(len(at), dtype=np.int64)
            count = np.ones(len(at), dtype=np.int32)
            for step in range(SEGMENT):
                m = alive[step]
                if not m:
                    break
                state[:m], ended = table.step(state[:m], flat[at[:m] + step])
                count[:m] += ended
            out[:, k] = np.bincount(doc[order], weights=count, minlength=len(texts))
            out[:, k] *= self.weight / np.maximum(sizes, 1)
        return out, some


def _suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """A suffix automaton whose transitions lie in an open-addressing hash table by
    ``state * width + class``, at most a quarter full; an empty place means that the phrase ends."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, text: list[int], width: int):
        nxt = _suffix_automaton(text)
        # One more state follows a letter that no labelled text has: such a letter is a phrase of
        # its own, so whatever comes next begins another one.
        self.width, alone = width, len(nxt)
        self.fresh = np.full(width, alone, dtype=np.int32)
        for c, to in nxt[0].items():
            self.fresh[c] = to
        nxt[0] = dict(enumerate(self.fresh.tolist()))  # the first letter begins the first phrase
        keys = np.fromiter((s * width + c for s, row in enumerate(nxt) for c in row), dtype=np.int64)
        to = np.fromiter((t for row in nxt for t in row.values()), dtype=np.int32)
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.next = np.full(1 << bits, -1, dtype=np.int32)
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.next[place[put]] = keys[put], to[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, to, place = keys[rest], to[rest], (place[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> self.shift).view(np.int64)

    def nbytes(self) -> int:
        return self.keys.nbytes + self.next.nbytes + self.fresh.nbytes

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended before the letter."""
        key = state * self.width + letter
        place = self._place(key)
        found = self.keys[place]
        to = self.next[place]
        odd = np.flatnonzero((found != key) & (found >= 0))
        while len(odd):
            place[odd] = (place[odd] + 1) & self.mask
            found, wanted = self.keys[place[odd]], key[odd]
            to[odd] = np.where(found == wanted, self.next[place[odd]], -1)
            odd = odd[(found != wanted) & (found >= 0)]
        ended = to < 0
        return np.where(ended, self.fresh[letter], to), ended


def _models(samples: tuple) -> Models:
    """The automata, built once per Python worker."""
    return kept(("languages", samples), lambda: Models(samples))


def labelled_samples(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS,
                     chars: int = SAMPLE_CHARS) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The bounded sample of each language, in the order of the languages' names.

    Hashes are reduced to distinct ones per language and only ``texts`` of them
    are kept by each task before the exchange, so a common language or a group
    of copies costs no more than another."""
    d = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = d.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= texts).select("lang", "h")
    place = F.pmod(F.xxhash64(F.lit("place"), F.col("text")), F.greatest(F.length("text") - chars, F.lit(0)).cast("long") + 1) + 1
    part = F.substr(F.col("text"), place.cast("int"), F.lit(chars))
    rows = d.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h") \
        .agg(F.min(part).alias("text")).collect()  # texts x chars per language at most
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        by.setdefault(r["lang"], []).append(r["text"])
    return tuple((name, tuple(t)) for name, t in sorted(by.items()))


def identify(docs: DataFrame, samples: tuple, keep: list[Column], text_col: str = "text",
             inside: str | None = None) -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``. Where one of
    them, named by ``inside``, is a struct that holds the text, the text is not sent twice.

    ``score`` is how far the winner lies below the runner-up, as a share of the
    runner-up's entropy (1 if there is only one language)."""
    ship(docs.sparkSession)
    d = docs.select(*keep) if inside else docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = d.columns if inside else d.columns[:-1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(samples) if samples else None
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                own = pc.struct_field(batch.column(names.index(inside)), text_col) if inside else batch.column(len(names))
                texts = [t or "" for t in own.to_pylist()]
                best, score, a = [], [], 0
                while a < len(texts):
                    b, size = a, 0
                    while b < len(texts) and (b == a or size + len(texts[b]) <= STEP_CHARS):
                        size += len(texts[b])
                        b += 1
                    x, y = _winners(models, texts[a:b])
                    best += x
                    score += y
                    a = b
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*names, "lang_pred", "score"])

    schema = d.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return d.mapInArrow(predict, schema)


def _winners(models: Models | None, texts: list[str]) -> tuple[list[str], list[float]]:
    if models is None:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    h, some = models.entropies(texts)
    win = np.argmin(h, axis=1)
    low = h[np.arange(len(h)), win]
    rest = h.copy()
    rest[np.arange(len(h)), win] = np.inf
    second = rest.min(axis=1)
    score = np.where(np.isinf(second), 1.0, 1 - low / np.maximum(second, 1e-300))
    return ([models.languages[k] if s else UNDETERMINED for k, s in zip(win, some, strict=True)],
            np.where(some, np.clip(score, 0, 1), 0.0).tolist())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def language_id(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; learned only from
    rows that are not held out."""
    out = held_out(F.col(id_col), folds)
    samples = labelled_samples(docs.where(~out), text_col, lang_col)
    return identify(docs, samples, [F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out")], text_col)
