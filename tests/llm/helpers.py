"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents():
    """NULLs in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} thing{i % 13}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old house on the hill today"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "b", 10), (3, base.upper(), "en", None, None),
        (4, base.replace("fox", "cat"), "en", "a", 1), (5, None, "en", "a", None), (6, "", None, "b", 0),
        (7, " \t\n ", "fr", "b", 3), (8, "one", "fr", "c", 3), (9, "one two", "fr", None, 7), (10, "%%% *** 123", None, "c", 0),
        (11, long, "en", "d", 5), (12, long + " end", "en", "d", 5), (13, "zwei drei vier", "de", "", 3),
        (None, "no id here at all", "en", "a", 1), (None, None, None, None, None), (14, base, "en", "a", 10),
        (14, base, "en", "a", 10), (15, "l'été déjà là", "fr", "c", 2), (16, "the  quick brown\tfox", "en", "a", 1),
    ]


def clashing(spark, rows=None):
    """The rows with extra columns whose names operators use for themselves."""
    from pyspark.sql import functions as F
    d = spark.createDataFrame(odd_documents() if rows is None else rows, DOC_SCHEMA)
    for c in ("row", "h", "size", "key", "n", "keep_id", "component_id", "lang_pred", "score", "length", "piece", "src",
              "_copies", "carry", "uid", "taken", "_text", "text_sha256"):
        d = d.withColumn(c, F.lit("x"))
    return d


def families(seed: int = 7, families: int = 6, copies: int = 25):
    """Near copies with random edits, exact copies, a passage shared by many, and single texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(60, 140))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: len(w) - r.randint(0, 12)]
            texts.append(" ".join(w))
    for _ in range(60):
        texts.append(" ".join(passage + [word() for _ in range(r.randint(3, 40))]))
    texts += [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(40)]
    texts += texts[:10] + [texts[0].upper(), None, "", " "]
    r.shuffle(texts)
    return [(i * 3 + 1, t, "en", "s", None) for i, t in enumerate(texts)]


def shingles(text: str | None, words: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def components(rows, words: int, percent: int):
    """{position: (set size, smallest id of the component)} by comparing all pairs."""
    sets = [shingles(r[1], words) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {i: (len(sets[i]), least.get(find(i))) for i in range(len(rows))}


def whole_copies(rows):
    """Copies of every document when documents are only taken whole, from rows of the mix."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        out.update({r.doc_id: 1 for r in own if not r["size"]})
        own = [r for r in own if r["size"]]
        copies = {r.doc_id: r.taken // r["size"] for r in own}
        rest = sum(r.taken % r["size"] for r in own)
        if rest:
            late = [r for r in own if copies[r.doc_id] == min(copies.values())]
            best = min(late, key=lambda r: (abs(r["size"] - rest), r["size"], r.doc_id))
            if abs(best["size"] - rest) < rest or not any(copies.values()):
                copies[best.doc_id] += 1
        out.update(copies)
    return out
