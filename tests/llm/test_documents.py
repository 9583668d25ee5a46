"""Operators on documents: brute force, the libraries themselves, and odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barflow.llm import exact_dedup as ed
from barflow.llm import lang_id as li
from barflow.llm import mixing as mx
from barflow.llm import ngram_join as nj
from barflow.llm import packing as pk
from barflow.llm import token_counts as tc
from barflow.llm import weak_labels as wl
from barflow.llm.queries import tokenizer_path
from tests.conftest import SF001, SF01
from tests.llm import helpers as H

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = "aZ éÉßñ\n\t\x0b\x1c\x1d\x85\xa0 　'sΣς漢字١२½Ⅷ́̈!.,#<|>$%​\U0001f600ǅİẖǰ   abc  "


def odd_texts(n):
    r = random.Random(3)
    out = ["".join(r.choice(ODD) for _ in range(r.randint(0, 50))) for _ in range(n)]
    return [*out, "<|endoftext|>", "a<|endoftext|> b", "x <|startoftext|>y<|endoftext|><|endoftext|>", "'S 's  '' !'s don't", "", None]


def empty(spark):
    return spark.createDataFrame([], H.DOC_SCHEMA)


# exact dedup -----------------------------------------------------------------

def brute_dedup(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    out = []
    for k, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(g), hashlib.sha256(k.encode()).hexdigest()) for r in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [ed.md5_128, lambda t: F.unhex(F.substring(F.md5(t), 1, 1).cast("string"))])
def test_dedup_is_exact_even_when_digests_collide(spark, digest):
    rows = H.odd_documents()
    got = ed.exact_dedup(H.clashing(spark), digest=digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_dedup(rows)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})


def test_dedup_stage_keeps_whole_rows(spark):
    d = H.clashing(spark)
    out = ed.drop_copies(d)
    assert out.columns == d.columns
    assert out.count() == len({x[3] for x in brute_dedup(H.odd_documents())})


# n-gram join -----------------------------------------------------------------

@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60), (1, 100)])
def test_ngram_join_equals_all_pairs(spark, words, percent):
    rows = H.families() + [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in H.odd_documents()]
    exp = collections.Counter((r[0], *v) for r, v in zip(rows, H.components(rows, words, percent).values(), strict=True))
    got = nj.ngram_jaccard_join(H.clashing(spark, rows), words, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == exp


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_ngram_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", block)
    rows = H.families(11, 3, 20) + [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in H.odd_documents()]
    sets = [H.shingles(r[1], 3) for r in rows]
    links = [sum(bool(i != j and a and b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets))
             for i, a in enumerate(sets)]
    got = nj.ngram_jaccard_join(H.clashing(spark, rows), 3, 80).collect()
    assert collections.Counter((r.doc_id, r.n_links) for r in got) == collections.Counter(
        (r[0], n) for r, n in zip(rows, links, strict=True))


def test_ngram_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", -1)
    rows = H.families(9, 3, 12)
    exp = {(r[0], *v) for r, v in zip(rows, H.components(rows, 3, 90).values(), strict=True)}
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, H.DOC_SCHEMA), 3, 90).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == exp


def test_links_are_verified_without_python_tasks(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(nj, "cut", lambda df, name: plans.setdefault(name, df))
    sets = spark.createDataFrame([(1, 4, [1, 2, 3, 4]), (2, 5, [1, 2, 3, 4, 5]), (3, 4, [1, 2, 8, 9])], "cls long, n long, tokens array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(r) for r in nj._verify(pairs, sets, 80).collect()] == [(1, 2)]
    assert "InArrow" not in plans["links"]._jdf.queryExecution().executedPlan().toString()


def test_a_worker_keeps_one_operators_tables(spark):
    from barflow.llm import common, lang_id
    models = lang_id._models((("en", ("the fox",)), ("de", ("der Fuchs",))))
    assert lang_id._models((("en", ("the fox",)), ("de", ("der Fuchs",)))) is models
    encoder = common.kept(("words", "x"), dict)
    assert list(common._KEPT.values()) == [encoder]
    common.forget()
    assert not common._KEPT


def test_near_stage_keeps_one_of_each_component(spark):
    rows = H.families()
    out = nj.keep_one_of_each(H.clashing(spark, rows), 5, 80)
    parts = H.components(rows, 5, 80)
    exp = sorted(r[0] for r, v in zip(rows, parts.values(), strict=True) if r[0] == v[1])
    assert sorted(r.doc_id for r in out.collect()) == exp


# packing ---------------------------------------------------------------------

def test_word_encoder_gives_the_librarys_ids():
    texts = [t or "" for t in odd_texts(3000)]
    library = Tokenizer.from_file(tokenizer_path(WORDS))
    ids, at = pk.WordEncoder(tokenizer_path(WORDS), 0, kept=500).encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


def check_packing(pieces, texts, capacity):
    library = Tokenizer.from_file(tokenizer_path(WORDS))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc], key=lambda p: p.piece)
        assert [p.start for p in own] == list(range(0, len(ids), capacity))
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq)


def test_packed_documents_hold_every_token_once(spark):
    texts = dict(enumerate(odd_texts(300)))
    texts[900] = " ".join(f"w{i}" for i in range(3000))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("x"))
    for chunk in (16_384, 50):
        pieces = pk.pack_pieces(pk.token_pieces(d, tokenizer_path(WORDS), 256), 256, chunk).collect()
        check_packing(pieces, texts, 256)


def test_best_two_fit_is_close_to_the_bound():
    r = np.random.default_rng(1)
    for lengths in (r.integers(1, 2049, 6000), np.minimum(2048, r.lognormal(5.5, 1.1, 6000).astype(int) + 1), np.array([700] * 50),
                    np.array([2048, 1, 1025, 1025, 1023]), np.array([], dtype=int)):
        bins, offset = pk.best_two_fit(lengths, 2048)
        fill = np.bincount(bins, weights=lengths) if len(lengths) else np.zeros(0)
        assert (fill <= 2048).all() and len(offset) == len(lengths)
        assert len(fill) <= -(-lengths.sum() // 2048) * 1.02 + (lengths > 682).all() * len(lengths) + 1


def test_best_two_fit_trades_the_smallest_for_two():
    # 6 + 3 leaves 1; trading 3 for 2 + 2 fills the bin.
    bins, _ = pk.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0] or bins.max() == 1


def plain_best_two_fit(lengths, capacity):
    """Greedy filling by falling length into the bin that fits best; then each bin's smallest piece gives way
    to two unpacked ones that fill its gap better. Returns the number of bins."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        own, gap = [left.pop(0)], 0
        gap = capacity - own[0]
        while True:
            fits = next((i for i, x in enumerate(left) if x <= gap), None)
            if fits is None:
                break
            own.append(left.pop(fits))
            gap -= own[-1]
        if len(own) > 1 and gap:
            room, best = own[-1] + gap, (own[-1], None)
            for i, x in enumerate(left):
                j = next((j for j in range(i + 1, len(left)) if left[j] <= room - x), None)
                if j is not None and x + left[j] > best[0]:
                    best = (x + left[j], (i, j))
            if best[1]:
                i, j = best[1]
                small = own.pop()
                own += [left[i], left[j]]
                del left[j], left[i]
                left = sorted([*left, small], reverse=True)
        bins += 1
    return bins


def test_packing_query_gives_the_contract_and_packs_like_a_plain_version(spark, tmp_path):
    from barflow.llm import queries as Q
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(int(r.paretovariate(0.8) * 40) % 2500)), "en", "a", 1) for i in range(250)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0), (5002, "long one " * 4000, "en", "a", 1)]
    H.clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op2_best_two_fit(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_path(WORDS))
    exp, lengths = {}, []
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = np.array(ids[k:k + 2048], dtype="<u4")
            exp[doc_id, k // 2048] = (k, len(own), zlib.crc32(own.tobytes()))
            lengths.append(len(own))
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in got} == exp and len(got) == len(exp)
    by = collections.defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(by) <= plain_best_two_fit(lengths, 2048) + 1


# token counts ----------------------------------------------------------------

def test_token_query_marks_long_documents(spark, tmp_path):
    from barflow.llm import queries as Q
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    texts = [" a" * n for n in (0, 1, 1023, 1024, 1025, 3000)] + [None, "é" * 700]
    H.clashing(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in Q.op4_token_counts(spark, str(tmp_path)).collect()}
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert n[3:5] == [1024, 1025] and got == {i: (len((t or "").encode()), k, k > 1024) for i, (t, k) in enumerate(zip(texts, n, strict=True))}


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_token_counts_equal_the_library(spark, hot):
    texts = odd_texts(1500)
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("freq", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tc.token_counts(d, tokenizer_path(BYTES), hot_pretokens=hot).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                   for i, t in enumerate(texts)}


def test_hot_table_stays_within_its_bound(spark):
    words = spark.createDataFrame([(f"w{i}", 1000 // (i + 1) + 1, 1) for i in range(300)], "pretoken string, freq long, n_pieces long")
    for most in (0, 1, 10, 299, 300):
        assert len(tc._hot(words, most)) <= most


# mixing ----------------------------------------------------------------------

def brute_targets(sizes, top=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / max(1, sum(w[x] for x in rest)) for s in rest}
        over = {s: top * sizes[s] for s in rest if share[s] > top * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (i % 37), None, [None, "a", "b", "c", "é", "z"][min(5, i % 11)], None) for i in range(900)]
    rows += [(9000, "one two", None, "tiny", None), (9001, None, None, "none", None)] + H.odd_documents()
    got = mx.mix_sources(H.clashing(spark, rows)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
    exp = brute_targets(sizes)
    assert len(got) == len(rows)
    assert {r.source: r.target for r in got} == pytest.approx(exp)
    assert all(abs(taken[s] - exp[s]) <= 0.5 + 1e-6 for s in exp)
    again = mx.mix_sources(H.clashing(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("step", [mx.LATTICE_STEP, 1])
def test_first_slot_is_that_of_the_schedule(spark, monkeypatch, step):
    monkeypatch.setattr(mx, "LATTICE_STEP", step)
    rows = [(i, "w " * (1 + i % 37), None, "abc"[i % 3], None) for i in range(300)]
    d = H.clashing(spark, rows)
    got = mx.mix_sources(d).collect()
    sizes = mx.sized(d)
    total = sizes.agg(F.sum("size")).first()[0]
    block, sources = mx.block_size(total), mx.source_targets(sizes)
    slots = mx.slot_schedule(sources, total, block).collect()
    key = lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()
    for source in "abc":
        at = 0
        for r in sorted((r for r in got if r.source == source), key=key):
            exp = min((s.position for s in slots if s.source == source and s.block * block < at + r["size"]
                       and at < s.block * block + s.words), default=None)
            assert r.first_slot == exp and (r.taken > 0) == (exp is not None)
            at += r["size"]


def test_the_mix_depends_on_the_slot_sequence(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 37), None, "abc"[i % 3], None) for i in range(300)]
    order = lambda: [r.doc_id for r in sorted(mx.mix_sources(H.clashing(spark, rows)).collect(), key=lambda r: (r.first_slot or 0, r.doc_id))]
    scheduled = order()
    monkeypatch.setattr(mx, "LATTICE_STEP", 1)
    assert order() != scheduled


def test_whole_documents_keep_sources_near_their_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.choice([3, 10, 50, 200, 900]), None, f"s{i % 5}", None) for i in range(200)]
    rows += [(900, "w " * 5000, None, "one", None), (901, "w " * 40, None, "small", None), (902, "w " * 30, None, "tiny", None)]
    rows += [(903, None, None, "tiny", None), (904, "", None, "empty", None)]
    d = H.clashing(spark, rows)
    found = mx.mix_sources(d, carry=mx.row_key(d))
    copies = {x.doc_id: x.copies for x in mx.whole_copies(found).collect()}
    plain = mx.mix_sources(d).collect()
    assert copies == H.whole_copies(plain)
    target, got, least = {x.source: x.target for x in plain}, collections.Counter(), {}
    for x in plain:
        got[x.source] += copies[x.doc_id] * x["size"]
        if x["size"]:
            least[x.source] = min(least.get(x.source, 10**9), x["size"])
    for s, t in target.items():
        if t >= 0.5:
            assert got[s] > 0 and abs(got[s] - t) <= max(least[s], t / 2), (s, t, got[s])
    assert all(abs(got[f"s{i}"] - target[f"s{i}"]) <= 0.06 * target[f"s{i}"] for i in range(5))
    assert copies[904] == copies[903] == 1


def test_slots_follow_the_weights_all_along(spark):
    sizes = mx.sized(spark.read.parquet(f"{SF01}/documents.parquet"))
    total = sizes.agg(F.sum("size")).first()[0]
    sources = mx.source_targets(sizes)
    block = mx.block_size(total)
    slots = mx.slot_schedule(sources, total, block).collect()
    target = {r.source: r.target for r in sources.collect()}
    words = collections.Counter()
    for s in slots:
        words[s.source] += s.words
    assert all(abs(words[s] - target[s]) <= 0.5 for s in target)
    slots.sort(key=lambda s: s.position)
    half = collections.Counter(s.source for s in slots[:len(slots) // 2])
    assert all(abs(half[s] * block - target[s] / 2) < 4 * block for s in target)
    for s in target:  # a source's blocks come in turn
        own = [(x.epoch, x.block) for x in slots if x.source == s]
        assert own == sorted(own) and len(set(own)) == len(own)


# language ID -----------------------------------------------------------------

def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet")
    got = li.language_id(d).where("held_out").join(d, "doc_id").select("lang", "lang_pred").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    out = {r.doc_id: r.held_out for r in li.language_id(d).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in out.items())


def naive_entropy(samples, sample, text, segment):
    """Greedy parse by substring search."""
    squeeze = lambda t: "".join(" " if not c.isalpha() else c for c in t.lower())
    one = lambda t: "".join(c for i, c in enumerate(t) if c != " " or i == 0 or t[i - 1] != " ")
    parts = [one(squeeze(t)) for t in sample]
    own, phrases = one(squeeze(text)), 0
    for a in range(0, len(own), segment):
        s, i = own[a:a + segment], 0
        while i < len(s):
            j = i
            while j < len(s) and any(s[i:j + 1] in p for p in parts):
                j += 1
            phrases += 1
            i = max(j, i + 1)  # a letter that the sample lacks is a phrase of its own
    most = max(sum(len(one(squeeze(t))) for t in s) for _, s in samples)
    return phrases * np.log2(most) / len(own)


def test_parse_counts_equal_substring_search():
    r = random.Random(2)
    samples = (("x", ("abracadabra, abba!", "cabbage bag")), ("y", ("xyzzy yxz zz", "zebra")))
    models = li.Models(samples)
    for _ in range(40):
        text = "".join(r.choice("abcgzxy  ,") for _ in range(r.randint(1, 700)))
        h, some = models.entropies([text])
        if some[0]:
            for k, (_, own) in enumerate(samples):
                assert h[0, k] == pytest.approx(naive_entropy(samples, own, text, li.SEGMENT))


def test_tables_do_not_grow_with_the_alphabet():
    r = random.Random(6)
    few = [chr(0x61 + i) for i in range(26)]
    many = [chr(0x4E00 + i) for i in range(3000)]
    text = lambda letters: "".join(r.choice(letters) for _ in range(li.SAMPLE_CHARS))
    samples = tuple((n, tuple(text(own) for _ in range(li.SAMPLE_TEXTS))) for n, own in (("few", few), ("many", many)))
    models = li.Models(samples)
    assert models.width > 3000 and all(t.nbytes() < 20_000_000 for t in models.tables)
    h, _ = models.entropies([text(few), samples[1][1][5]])
    assert h[0, 0] < h[0, 1] and h[1, 1] < h[1, 0]


def test_a_shared_opening_is_not_what_is_learned(spark):
    opening = "permission is hereby granted free of charge to any person obtaining a copy of this work " * 8
    d = spark.read.parquet(f"{SF01}/documents.parquet").where("lang is not null and length(text) > 900") \
        .withColumn("text", F.concat(F.lit(opening), F.col("text")))
    assert len(opening) > li.SAMPLE_CHARS
    samples = li.labelled_samples(d)
    assert all(len(t) == li.SAMPLE_CHARS for _, texts in samples for t in texts)
    assert sum(t == opening[:li.SAMPLE_CHARS] for _, texts in samples for t in texts) <= 2
    got = li.identify(d.withColumn("text", F.substr(F.col("text"), F.lit(len(opening) + 1), F.length("text"))), samples, [F.col("lang")]).collect()
    assert len(got) > 100 and sum(x.lang == x.lang_pred for x in got) / len(got) > 0.97


def test_a_language_with_hardly_any_text_does_not_win(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet")
    rare = spark.createDataFrame([(10**6, "ab", "xx", "s", 2)], d.schema)
    got = li.language_id(d.unionByName(rare)).where("doc_id < 1000000").groupBy("lang_pred").count().collect()
    assert "xx" not in {r.lang_pred for r in got}


# weak labels -----------------------------------------------------------------

def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    n, m = 40_000, len(wl.LABELLERS)
    truth = r.random(n) < 0.7
    right = np.linspace(0.65, 0.95, m)
    votes = np.where(r.random((n, m)) < 0.2, wl.NONE,
                     np.where((r.random((n, m)) < right) == truth[:, None], wl.GOOD, wl.BAD))
    patterns, counts = np.unique((votes * 3 ** np.arange(m - 1, -1, -1)).sum(1), return_counts=True)
    share, table, _ = wl.expectation_maximisation(wl.votes_of(patterns), counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.02)
    assert table[1, :, wl.GOOD] == pytest.approx(0.8 * right, abs=0.03)
    assert table[0, :, wl.BAD] == pytest.approx(0.8 * right, abs=0.03)


def plain_scores(texts):
    """Votes, EM over documents and the linear scorer, document by document."""
    votes = np.array([[vote(wl.features(t)) for vote in wl.LABELLERS.values()] for t in texts])
    given, good = (votes != wl.NONE).sum(1), (votes == wl.GOOD).sum(1)
    p = (good + 0.5) / (given + 1)
    for _ in range(500):
        share, odds = p.mean(), np.zeros(len(texts))
        for j in range(votes.shape[1]):
            seen = np.array([[(w * (votes[:, j] == v)).sum() + 0.1 for v in range(3)] for w in (1 - p, p)])
            rate = seen / seen.sum(1, keepdims=True)
            odds += np.log(rate[1, votes[:, j]]) - np.log(rate[0, votes[:, j]])
        new = 1 / (1 + np.exp(-(odds + math.log(share) - math.log(1 - share))))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-10:
            break
    kind = lambda c: "A" if 65 <= c < 91 else "a" if 97 <= c < 123 or c >= 128 else "0" if 48 <= c < 58 else chr(c)
    bags = []
    for t in texts:
        words, bag = t.split(), collections.Counter()
        for i, w in enumerate(words):
            bag[xxhash.xxh32_intdigest(w, 1) % wl.BUCKETS] += 1
            shape = "".join(k for k, _ in itertools.groupby(map(kind, w)))
            bag[xxhash.xxh32_intdigest(shape.encode(), 2) % wl.BUCKETS] += 1
            if i and words[i - 1] == w:
                bag[wl.AGAIN] += 2
        bags.append({k: n / bag.total() for k, n in bag.items()})
    weights, bias, seen = collections.defaultdict(float), 0.0, collections.defaultdict(lambda: 1e-12)
    z = lambda bag: sum(weights[k] * v for k, v in bag.items()) + bias
    for _ in range(wl.ROUNDS):
        grad, own = collections.Counter(), 0.0
        for bag, y in zip(bags, p, strict=True):
            off = 1 / (1 + math.exp(-z(bag))) - y
            own += off
            for k, v in bag.items():
                grad[k] += v * off
        for k in list(weights) + list(grad):
            grad[k] += 0.0
        step = {k: g / len(texts) + wl.RIDGE * weights[k] for k, g in grad.items()}
        step["bias"] = own / len(texts) + wl.RIDGE * bias
        for k, g in step.items():
            seen[k] += g * g
            change = wl.STEP * g / math.sqrt(seen[k])
            if k == "bias":
                bias -= change
            else:
                weights[k] -= change
    return given, p, [1 / (1 + math.exp(-z(bag))) for bag in bags]


def test_quality_query_equals_a_plain_version(spark, tmp_path):
    from barflow.llm import queries as Q
    d = spark.read.parquet(f"{SF001}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in d.collect()] + [(10_000 + i, *r[1:]) for i, r in enumerate(H.odd_documents()) if i != 10]
    H.clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op5_weak_labels(spark, str(tmp_path)).collect()}
    given, p, score = plain_scores([(r[1] or "").encode() for r in rows])
    assert len(got) == len(rows)
    for r, n, own, s in zip(rows, given, p, score, strict=True):
        x = got[r[0]]
        assert x.n_votes == n and x.posterior == pytest.approx(own, abs=1e-6) and x.score == pytest.approx(s, abs=1e-6) and x.keep == (x.score >= 0.5)


def test_a_round_of_the_fit_is_one_job(spark, monkeypatch):
    monkeypatch.setattr(wl, "ROUNDS", 5)
    d = H.clashing(spark, [(i, "some words of a text " * (i % 9), "en", "a", 1) for i in range(200)]).repartition(16)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        wl.quality_scores(d).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) <= 5 + 12


def test_scorer_ranks_labelled_quality(spark):
    got = wl.quality_scores(spark.read.parquet(f"{SF01}/documents.parquet")) \
        .join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").toPandas()
    rank = got["score"].rank()
    good = got["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and got.loc[good, "keep"].mean() > 0.97


# odd rows --------------------------------------------------------------------

OPERATORS = {
    "dedup": lambda d: ed.exact_dedup(d),
    "ngram": lambda d: nj.ngram_jaccard_join(d, 3, 90),
    "pack": lambda d: pk.pack_documents(d, tokenizer_path(WORDS)),
    "tokens": lambda d: tc.token_counts(d, tokenizer_path(BYTES)),
    "mix": lambda d: mx.mix_sources(d),
    "language": lambda d: li.language_id(d),
    "quality": lambda d: wl.quality_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_odd_rows(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0
    got = OPERATORS[name](H.clashing(spark)).collect()
    ids = collections.Counter(r.doc_id for r in got if name != "pack" or r.piece == 0)
    assert ids == collections.Counter(r[0] for r in H.odd_documents())


def test_texts_without_letters_are_undetermined(spark):
    got = {(r.doc_id, r.lang_pred) for r in li.language_id(H.clashing(spark)).collect()}
    for doc in (5, 6, 7, 10):
        assert (doc, "und") in got
    assert (13, "und") not in got
    nothing = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [tuple(r) for r in li.language_id(nothing).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_small_table_is_read_whole(spark):
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert tc.token_counts(spark.read.parquet(f"{SF001}/documents.parquet"), tokenizer_path(BYTES)).count() == n
