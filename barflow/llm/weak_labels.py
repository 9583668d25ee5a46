"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on a text.
Expectation-maximisation over all documents' votes estimates the share of good
documents and how each labeller votes on good and on bad ones; this gives
every vote pattern a posterior probability of being good. The posteriors then
train a hashed linear (logistic) scorer on words and word shapes, which scores
every whole text.

NULL text counts as empty. Repeated rows and NULL ids are rows like others.
Empty input gives an empty result. Only id and text are read, so other columns
may have any name.

EM reads the counts of vote patterns over all documents; there are at most
``3 ** len(LABELLERS)`` patterns. The scorer is fitted on a sample of about
``FIT_DOCS`` rows (those whose hash falls below a bound); its gradient is
summed over the partitions in every round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut, ship, text_or_empty
from barflow.llm.packing import steps

FIT_DOCS = 20_000
#: Partitions of those rows; each gives one vector of gradients a round.
FIT_PARTS = 8
#: Hash buckets of the scorer, rounds and step of its fit, and the weight of its ridge penalty.
BUCKETS, ROUNDS, STEP, RIDGE = 1 << 14, 30, 2.0, 1e-5
#: The bucket of words that repeat the word before them.
AGAIN = 0
KEPT_WORDS = 400_000
STEP_BYTES = 4_000_000
NONE, BAD, GOOD = 0, 1, 2

_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_SIGNS = b"#$%&*+/<=>@[\\]^_`{|}~"


def _vote(x: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def features(text: bytes) -> dict[str, float]:
    """What the labellers look at."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    letters = capitals + len(text) - len(text.translate(None, _SMALL))
    signs = len(text) - len(text.translate(None, _SIGNS))
    bare = sum(c for w, c in distinct.items() if w.isascii() and not any(map(bytes.isalnum, (w[:1], w[-1:]))))
    ends = sum(c for w, c in distinct.items() if w[-1] in b".!?")
    size = max(1, sum(len(w) for w in words))
    return {"words": n, "length": size / max(1, n), "signs": signs / size, "capitals": capitals / max(1, letters),
            "distinct": len(distinct) / max(1, n), "common": max(distinct.values(), default=0) / max(1, n),
            "lines": len(lines), "new_lines": len(set(lines)) / max(1, len(lines)), "ends": ends / max(1, n),
            "bare": bare / max(1, n)}


#: name: vote from the features
LABELLERS = {
    "length": lambda f: _vote(0, f["words"] < 5, f["words"] >= 50),
    "word length": lambda f: _vote(0, not 2 <= f["length"] <= 14, 3 <= f["length"] <= 10),
    "signs": lambda f: _vote(0, f["signs"] > 0.05, f["signs"] < 0.01),
    "capitals": lambda f: _vote(0, f["capitals"] > 0.3, f["capitals"] < 0.12),
    "distinct words": lambda f: NONE if f["words"] < 20 else _vote(0, f["distinct"] < 0.3, f["distinct"] > 0.5),
    "common word": lambda f: NONE if f["words"] < 20 else _vote(0, f["common"] > 0.2, f["common"] < 0.12),
    "repeated lines": lambda f: NONE if f["lines"] < 4 else _vote(0, f["new_lines"] < 0.7, f["new_lines"] > 0.95),
    "sentence ends": lambda f: NONE if f["words"] < 20 else _vote(0, not 0.01 <= f["ends"] <= 0.5, 0.03 <= f["ends"] <= 0.25),
    "bare signs": lambda f: _vote(0, f["bare"] > 0.15, f["bare"] < 0.02),
}


def pattern(text: bytes) -> int:
    """All votes on a text as one number in base 3."""
    f, out = features(text), 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(f)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """Votes (patterns by labellers) of pattern numbers."""
    m = len(LABELLERS)
    return (np.asarray(patterns)[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 500,
                             tolerance: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, vote probabilities (class, labeller, vote) and posteriors per pattern.

    Starts from the share of good votes among the votes given, so the class
    called good is the one that most labellers call so."""
    good = (votes == GOOD).sum(1)
    given = (votes != NONE).sum(1)
    p = (good + 0.5) / (given + 1.0)
    one_hot = np.stack([votes == v for v in (NONE, BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        share = float((counts * p).sum() / counts.sum())
        table = np.stack([np.einsum("i,ijk->jk", counts * w, one_hot) + 0.1 for w in (1 - p, p)])
        table /= table.sum(axis=2, keepdims=True)
        log = np.einsum("ijk,cjk->ic", one_hot, np.log(table)) + np.log([max(1 - share, 1e-12), max(share, 1e-12)])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        moved = float(np.abs(new - p).max())
        p = new
        if moved < tolerance:
            break
    return share, table, p


class Hashed:
    """Buckets of a text's words, of their shapes and of immediate repeats; a word is looked at once."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.shape = re.compile(rb"([A-Z])[A-Z]+|([a-z\x80-\xff])[a-z\x80-\xff]+|([0-9])[0-9]+|([^A-Za-z0-9])\4+").sub

    def _buckets(self, word: bytes) -> tuple[int, int]:
        shape = self.shape(lambda m: m[0][:1], word)
        shape = bytes(65 if 65 <= c < 91 else 97 if c >= 97 and c < 123 or c >= 128 else 48 if 48 <= c < 58 else c for c in shape)
        return xxhash.xxh32_intdigest(word, 1) % BUCKETS, xxhash.xxh32_intdigest(shape, 2) % BUCKETS

    def of(self, text: bytes) -> np.ndarray:
        known, words = self.known, text.split()
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._buckets(w)
        again = sum(map(bytes.__eq__, words, words[1:]))
        return np.concatenate([np.array([known[w] for w in words], dtype=np.int64).ravel(), np.full(2 * again, AGAIN)])


_HASHED: list[Hashed] = []


def _hashed() -> Hashed:
    """One per Python worker, kept from task to task."""
    if not _HASHED:
        _HASHED.append(Hashed())
    return _HASHED[0]


def vote_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, pattern`` of every document, written once; ``h`` is a hash of id and text."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, texts in steps(b.column(0), b.column(1), STEP_BYTES):
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.array([_row_hash(i, t) for i, t in zip(own, texts, strict=True)], pa.int64()),
                    pa.array([pattern(t) for t in texts], pa.int64())], names=["doc_id", "h", "pattern"])

    ship(docs.sparkSession)
    return cut(_texts(docs, id_col, text_col).mapInArrow(vote, "doc_id bigint, h bigint, pattern bigint"), "votes")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def _row_hash(doc_id: int | None, text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, (doc_id or 0) & (2**64 - 1)) >> 1


def fit_scorer(docs: DataFrame, posterior: dict[int, float], rows: int, id_col: str = "doc_id",
               text_col: str = "text") -> np.ndarray:
    """Weights of the buckets, bias last: logistic regression on the posteriors by full-batch
    steps with per-weight rates. The driver holds only the weights."""
    bound = 2**63 if rows <= FIT_DOCS else int(FIT_DOCS / rows * 2**63)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed()
        for b in batches:
            at, val, target = [], [], []
            for i, t in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
                text = t.as_py()
                if _row_hash(i.as_py(), text) < bound:
                    k, n = np.unique(hashed.of(text), return_counts=True)
                    at.append(k.tolist())
                    val.append((n / max(1, n.sum())).tolist())
                    target.append(posterior[pattern(text)])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int64())), pa.array(val, pa.list_(pa.float64())),
                                              pa.array(target, pa.float64())], names=["at", "val", "target"])

    # About FIT_DOCS rows at any size of the corpus, so a few partitions hold them.
    fit = cut(_texts(docs, id_col, text_col).mapInArrow(sample, "at array<bigint>, val array<double>, target double")
              .repartition(FIT_PARTS), "fit")
    n = max(1, fit.count())
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-12)
    for _ in range(ROUNDS):
        def gradient(batches: Iterator[pa.RecordBatch], w=weights) -> Iterator[pa.RecordBatch]:
            g = np.zeros(BUCKETS + 1)
            for b in batches:
                at, val, target = b.column(0), b.column(1), b.column(2).to_numpy()
                size = np.diff(at.offsets.to_numpy())
                row = np.repeat(np.arange(len(size)), size)
                k, v = at.flatten().to_numpy(), val.flatten().to_numpy()
                z = np.bincount(row, weights=w[k] * v, minlength=len(size)) + w[-1]
                off = 1 / (1 + np.exp(-z)) - target
                g += np.bincount(k, weights=v * off[row], minlength=BUCKETS + 1)
                g[-1] += off.sum()
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

        parts = fit.mapInArrow(gradient, "g binary").collect()  # one job a round; FIT_PARTS vectors or a few more
        g = sum((np.frombuffer(r[0]) for r in parts), np.zeros(BUCKETS + 1)) / n + RIDGE * weights
        seen += g * g
        weights = weights - STEP * g / np.sqrt(seen)
    return weights


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, n_votes, posterior, score, keep`` (``score >= least``)."""
    votes = vote_patterns(docs, id_col, text_col)
    table = votes.groupBy("pattern").count().collect()  # 3 ** len(LABELLERS) rows at most
    schema = "doc_id bigint, n_votes int, posterior double, score double, keep boolean"
    if not table:
        return docs.sparkSession.createDataFrame([], schema)
    patterns, counts = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=float)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    _, _, p = expectation_maximisation(votes_of(patterns), counts)
    posterior = dict(zip(patterns.tolist(), p.tolist(), strict=True))
    n_votes = dict(zip(patterns.tolist(), (votes_of(patterns) != NONE).sum(1).tolist(), strict=True))
    weights = fit_scorer(docs, posterior, int(counts.sum()), id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed()
        for b in batches:
            for own, texts in steps(b.column(0), b.column(1), STEP_BYTES):
                own_patterns = [pattern(t) for t in texts]
                z = np.array([weights[k].mean() if len(k := hashed.of(t)) else 0.0 for t in texts]) + weights[-1]
                s = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.array([n_votes[k] for k in own_patterns], pa.int32()),
                    pa.array([posterior[k] for k in own_patterns], pa.float64()), pa.array(s), pa.array(s >= least)],
                    names=["doc_id", "n_votes", "posterior", "score", "keep"])

    return _texts(docs, id_col, text_col).mapInArrow(score, schema)
