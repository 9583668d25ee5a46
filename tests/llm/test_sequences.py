"""Periodic runs, SentencePiece coding and ranked search: brute force and the library itself."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor

from barflow.llm import lexical_search as ls
from barflow.llm import periodic_runs as pr
from barflow.llm import piece_coding as pc
from barflow.llm import queries as Q
from barflow.llm.queries import tokenizer_path
from tests.conftest import SF001
from tests.llm import helpers as H

MODEL = "piece_bpe_32k.model"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def empty(spark):
    return spark.createDataFrame([], H.DOC_SCHEMA)


# periodic runs ---------------------------------------------------------------

def brute_runs(words, least=12):
    """Every maximal stretch of every lag, kept if no smaller lag fits it."""
    n, found = len(words), set()
    for p in range(1, n):
        i = p
        while i < n:
            k = i
            while k < n and words[k] == words[k - p]:
                k += 1
            if k - i + p >= max(least, 2 * p):
                found.add((i - p, k - i + p, p))
            i = k + 1
    whole = lambda s, n, q: all(words[i] == words[i - q] for i in range(s + q, s + n))
    return sorted((r for r in found if not any(whole(r[0], r[1], q) for q in range(1, r[2]))), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def periodic_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        letters, size = "abcdef"[:r.choice([1, 2, 2, 3, 6])], r.randint(0, 90)
        w = [r.choice(letters) for _ in range(size)]
        for _ in range(r.randint(0, 3)):
            a, p = r.randint(0, size), r.randint(1, 12)
            for i in range(a + p, r.randint(a, size)):
                w[i] = w[i - p]
        yield " ".join(w)


@pytest.mark.parametrize("least", [12, 5, 1])
def test_runs_equal_brute_force(least):
    texts = [*periodic_texts(least, 250), "a " * 40, "a a a b " * 9, "x " + "a b " * 8 + "a c " + "a b " * 8]
    sizes, runs, collapsed = pr.runs_of_texts([t.encode() for t in texts], least)
    for t, n, own, c in zip(texts, sizes, runs, collapsed, strict=True):
        assert n == len(t.split())
        assert own == brute_runs(t.split(), least)
        assert c.decode().split() == brute_collapse(t.split(), own)


def test_equal_hashes_ahead_only_cost_time(monkeypatch):
    monkeypatch.setattr(pr, "_MIX", pr.np.uint64(0))  # every word has the same hash
    texts = [t for t in periodic_texts(9, 60) if t]
    assert pr.runs_of_texts([t.encode() for t in texts])[1] == [brute_runs(t.split()) for t in texts]


def test_long_uniform_texts_stay_cheap():
    for t, runs in ((b"a " * 60_000, [(0, 60_000, 1)]), (b"a b c d e f g " * 9_000, [(0, 63_000, 7)])):
        assert pr.runs_of_texts([t])[1] == [runs]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return [w.decode() for w in words]
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p].decode() for i in range(n)]


def test_runs_query_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = H.odd_documents()[:10] + [(100 + i, t, "en", "a", 1) for i, t in enumerate(periodic_texts(8, 60))]
    rows += [(1000 + i, " ".join(r.choice("uvwxyz") + str(r.randint(0, 9)) for _ in range(r.randint(1, 200))), "en", "a", 1) for i in range(60)]
    rows += [(None, "a b " * 9, None, None, None), (1001, "a\tb\n" * 9, "en", "a", 1), (1001, "a\tb\n" * 9, "en", "a", 1)]
    H.clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    exp = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        exp.append((doc_id, len(runs), s, n, q, 1000 * n // q if runs else None,
                    sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(brute_collapse(words, runs)))))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(exp)
    assert sum(e[1] for e in exp) > 20
    assert pr.periodic_runs(empty(spark)).count() == 0


# SentencePiece ---------------------------------------------------------------

ODD = "aZ éÉßñ\n\t\x0b\x00\x85\xa0 ▁▁  　'sΣ漢字١½Ⅷ́<s></s>[INST]<unk><0x0A>\U0001f600\r\n  ab  ﻿"


def test_pieces_equal_the_library(spark, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "  ", "▁", "a ", "▁ ▁a", "<s> a</s>", "\r\r", "x" * 30_000, None, "ab " * 20_000]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)] * 2
    H.clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sp = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    exp = collections.Counter()
    for doc_id, t, *_ in rows:
        ids = sp.encode(t or "")
        exp[(doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    got = Q.op12_piece_coding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == exp
    assert pc.piece_coding(empty(spark), tokenizer_path(MODEL)).count() == 0


def test_a_full_chunk_table_starts_afresh():
    sp = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    table = pc.ChunkTable(tokenizer_path(MODEL), kept=3)
    for t in ("one two three four five", "two  six", "one seven two", ""):
        ids, ends, decoded = table.code([t, t])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t)] * 2
        assert decoded == [t, t]


# ranked search ---------------------------------------------------------------

def terms(t):
    return ls.terms_of((t or "").encode())


def brute_search(docs, items, k):
    counted = [(d[0], collections.Counter(terms(d[1]))) for d in docs]
    counted = [c for c in counted if c[1]]
    df = collections.Counter(t for _, c in counted for t in c)
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    out = collections.Counter()
    for item, text in items:
        found = []
        for doc_id, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0))
        for rank, (s, none, doc_id) in enumerate(sorted(found)[:k], 1):
            out[(item, rank, None if none else doc_id, -s)] += 1
    return out


@pytest.mark.parametrize(("k", "block"), [(5, 4_000_000), (3, 900), (20, 1)])
def test_search_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(ls, "FIRST_BUCKET", 8)
    monkeypatch.setattr(ls, "BUCKET", 64)
    r = random.Random(k)
    word = lambda: r.choice(["Été", "x1", "the", "THE", "of", "über", "٣", *(f"w{int(r.paretovariate(.5)) % 97}" for _ in range(9))])
    docs = [(i % 300, " ".join(word() for _ in range(r.choice([0, 1, 5, 30, 200]))), "en", "a", 1) for i in range(400)]
    docs += [(1000 + i, "the same text of w1 w2 w3", "en", "a", 1) for i in range(40)] + H.odd_documents()
    items = [(i, " ".join(word() for _ in range(r.randint(1, 25)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "--- !"), (53, "nowhere"), (None, "the the of"), (54, "x1"), (54, "x1")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for c in ("rank", "doc_id", "score", "upto", "block", "query"):
        asked = asked.withColumn(c, ls.F.lit("x"))
    got = ls.ranked_search(H.clashing(spark, docs), asked, k, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == brute_search(docs, items, k)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.ranked_search(empty(spark), items).count() == 0
    assert ls.ranked_search(H.clashing(spark), items.limit(0)).count() == 0


def test_bounds_pass_over_buckets_and_vectors():
    np = ls.np
    weights = np.array([100, 50, 1, 700])
    query = ls.Query({0: 1, 3: 2}, weights)
    terms_, impacts, sizes = np.array([0, 3, 1, 2, 3]), np.array([900, 800, 700, 900, 10]), np.array([2, 2, 1])
    row = np.repeat(np.arange(3), sizes)
    norms = np.sqrt(np.bincount(row, weights=weights[terms_] * impacts.astype(float) ** 2))
    bucket = ls.Bucket(terms_, impacts, sizes, norms, np.sqrt(weights))
    assert bucket.scores(query, np.arange(3)).tolist() == [900 * 100 + 2 * 700 * 800, 0, 2 * 700 * 10]
    assert bucket.survivors(query, 1_210_000).tolist() == [0]
    assert bucket.survivors(query, 10 ** 9).tolist() == []


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    assert sorted(map(tuple, Q.op13_ranked_search(spark, SF001).collect())) == sorted(con.execute(Q.OP13_SQL).fetchall())
