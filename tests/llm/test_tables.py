"""Tool calls, URL lists, vectors, the pipeline and the queries' SQL."""

import collections
import datetime as dt
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barflow.llm import lang_id as li
from barflow.llm import queries as Q
from barflow.llm.common import cut
from barflow.llm.components import components
from barflow.llm.multi_index import MultiIndex, visit
from barflow.llm.tool_calls import link_tool_calls
from barflow.llm.url_lists import judge
from tests.conftest import SF001, SF01
from tests.llm import helpers as H
from tools.oracle_check import TABLES, digest, norm

CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SPECS = "tool string, name string, type string, required boolean"
SPEC_ROWS = [("f", "a", "integer", True), ("f", "b", "string", False), ("f", "c", "array", False), ("g", "x", "number", True)]


def linked(spark, calls, results):
    out = link_tool_calls(spark.createDataFrame(calls, CALLS).withColumn("uid", F.lit("x")).withColumn("depth", F.lit("x")),
                          spark.createDataFrame(results, RESULTS), spark.createDataFrame(SPEC_ROWS, SPECS))
    return out.orderBy(F.col("conv_id").isNull(), "conv_id", "position").collect()


def test_tool_calls_are_linked_ordered_and_validated(spark):
    calls = [
        (1, 9, "c", "f", '{"b":"é", "a": 1.0}', "b"), (1, 5, "b", "g", '{"x":"no","y":1}', "a"), (1, 7, "a", "f", '{"c":{}}', None),
        (1, 8, "z", "f", "[1]", "gone"), (1, 1, "p", "f", '{"a":1,"a":2}', "q"), (1, 2, "q", "h", "{}", "p"),
        (1, 3, "s", "f", '{"a":1}', "s"), (1, 4, "t", "f", '{"a":1}', "s"), (2, 1, "a", "f", '{"a":2}', None),
        (2, 0, "a", "f", '{"a":3}', None), (2, 1, None, "f", None, None), (None, 1, "a", None, None, None),
    ]
    results = [(1, 10, "a", "ra"), (1, 11, "a", "late"), (1, 12, "lost", "who"), (2, 5, "a", None), (2, 6, None, "loose")]
    got = linked(spark, calls, results)
    one = [r for r in got if r.conv_id == 1]
    assert [r.position for r in one] == list(range(len(one)))
    place = {r.call_id: r.position for r in one}
    assert place["a"] < place["b"] < place["c"]
    by = {(r.conv_id, r.call_id): r for r in got}
    assert by[1, "a"].n_results == 2 and json.loads(by[1, "a"].message)["result"] == "ra"
    assert by[1, "a"].errors == ["missing a", "type c"] and by[1, "c"].errors == []
    assert by[1, "b"].errors == ["type x", "unknown y"] and by[1, "q"].errors == ["unknown tool", "cycle"]
    assert by[1, "z"].errors == ["not an object", "unknown after"] and by[1, "p"].errors == ["not json", "cycle"]
    assert by[1, "s"].errors == ["cycle"] == by[1, "t"].errors and by[1, "s"].depth is None
    assert by[1, "lost"].status == "orphan" and by[1, "z"].status == "unanswered"
    assert '"arguments":{"a":1,"b":"é"}' in by[1, "c"].message
    assert by[2, "a"].n_calls == 2 and json.loads(by[2, "a"].message)["arguments"] == {"a": 3}
    assert len(got) == 13


def test_long_chains_need_few_rounds(spark):
    calls = [(1, 500 - i, f"c{i}", "f", '{"a":1}', f"c{i - 1}" if i else None) for i in range(300)]
    assert [r.call_id for r in linked(spark, calls, [])] == [f"c{i}" for i in range(300)]


def brute_depths(own):
    """Longest way to a call that names none, by walking; None on a cycle or behind one."""
    done: dict = {}
    while True:
        new = {c: 1 + max((done[a] for a in ups), default=-1) for c, ups in own.items() if c not in done and all(a in done for a in ups)}
        if not new:
            return {c: done.get(c) for c in own}
        done |= new


def test_calls_follow_all_that_they_wait_for(spark):
    r = np.random.default_rng(3)
    calls, exp = [], {}
    for conv in range(12):
        n = int(r.integers(1, 40))
        ids = [f"c{i}" for i in r.permutation(n)]
        own = {}
        for i, c in enumerate(ids):
            ups = {ids[int(j)] for j in r.integers(0, i, r.integers(0, 4))} if i else set()
            if r.random() < 0.04:
                ups.add(ids[int(r.integers(0, n))])  # may close a cycle
            own[c] = ups
            calls.append((conv, int(r.integers(0, 99)), c, "f", '{"a":1}', [*ups, *(["gone"] if r.random() < 0.1 else []), *list(ups)[:1], None]))
        exp.update({(conv, c): d for c, d in brute_depths(own).items()})
    d = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>")
    got = link_tool_calls(d, spark.createDataFrame([], RESULTS), spark.createDataFrame(SPEC_ROWS, SPECS)).collect()
    assert {(x.conv_id, x.call_id): x.depth for x in got} == exp
    assert any(v is None for v in exp.values()) and max(v or 0 for v in exp.values()) > 5
    place, after = {(x.conv_id, x.call_id): x.position for x in got}, {(c[0], c[2]): c[5] for c in calls}
    for (conv, c), d in exp.items():
        waits = [a for a in after[conv, c] if a not in (None, "gone")]
        assert d is None or all(place[conv, a] < place[conv, c] for a in waits)
        errors = next(x.errors for x in got if (x.conv_id, x.call_id) == (conv, c))
        assert ("cycle" in errors) == (d is None) and ("unknown after" in errors) == ("gone" in after[conv, c])


def test_nested_properties_values_and_bounds(spark):
    spec = [("s", "q", "string", True, ["red", "blue"], None, None), ("s", "n", "integer", False, None, 1.0, 9.0), ("s", "o", "object", False, None, None, None),
            ("s", "o.x", "number", True, None, None, 2.5), ("s", "o.p", "object", False, None, None, None), ("s", "o.p.z", "boolean", True, None, None, None),
            ("s", "any", "object", False, None, None, None)]
    schemas = spark.createDataFrame(spec, "tool string, name string, type string, required boolean, allowed array<string>, minimum double, maximum double")
    cases = {
        '{"q":"red","n":9,"o":{"x":2.5,"p":{"z":true}},"any":{"k":{"l":1}}}': [],
        '{"q":"green","n":0}': ["bounds n", "value q"], '{"q":"blue","n":10,"o":{}}': ["bounds n", "missing o.x"],
        '{"q":"blue","o":{"x":3,"p":{}}}': ["bounds o.x", "missing o.p.z"], '{"q":"blue","o":{"x":"1","w":2}}': ["type o.x", "unknown o.w"],
        '{"q":7,"o":5}': ["type o", "type q"], '{"q":"red","o":{"x":1,"p":{"z":1,"y":2}}}': ["type o.p.z", "unknown o.p.y"], "{}": ["missing q"], "[]": ["not an object"]}
    calls = spark.createDataFrame([(1, i, f"c{i}", "s", c, None) for i, c in enumerate(cases)], CALLS)
    got = {x.call_id: x.errors for x in link_tool_calls(calls, spark.createDataFrame([], RESULTS), schemas).collect()}
    assert [got[f"c{i}"] for i in range(len(cases))] == list(cases.values())


def brute_tool_rows(calls, results, specs):
    """Every output row of the linking, from plain dictionaries."""
    by_conv = collections.defaultdict(dict)
    for c in calls:
        by_conv[c.conv_id][c.call_id] = c
    found = collections.defaultdict(list)
    for r in results:
        found[r.conv_id, r.call_id].append(r)
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool}
    text = lambda d: json.dumps(d, ensure_ascii=False, separators=(",", ":"))
    canon = lambda v: json.loads(json.dumps(v, sort_keys=True))
    rows = []
    for conv, own in by_conv.items():
        for c in own.values():
            depth, at, unknown = 0, c, c.after is not None and c.after not in own
            while at.after in own:
                depth, at = depth + 1, own[at.after]
            spec = {s.name: s for s in specs if s.tool == c.tool}
            try:
                args = json.loads(c.arguments)
            except ValueError:
                args = None
            if not spec:
                errors = ["unknown tool"]
            elif args is None:
                errors = ["not json"]
            else:
                errors = sorted([f"missing {n}" for n, s in spec.items() if s.required and n not in args]
                                + [f"unknown {n}" for n in args if n not in spec]
                                + [f"type {n}" for n, v in args.items() if n in spec and (
                                    not isinstance(v, kinds[spec[n].type]) or isinstance(v, bool) != (spec[n].type == "boolean"))])
            errors += ["unknown after"] if unknown else []
            r = min(found[conv, c.call_id], key=lambda r: r.turn, default=None)
            message = {"arguments": None if args is None else canon(args), "arguments_text": c.arguments if args is None else None,
                       "call_id": c.call_id, "conv_id": conv, "errors": errors, "name": c.tool, "result": r and r.content, "turn": c.turn}
            rows.append((conv, depth, c.turn, c.call_id, "answered" if r else "unanswered", len(found[conv, c.call_id]), errors,
                         text({k: v for k, v in message.items() if v is not None})))
    for (conv, call), own in found.items():
        if own and call not in by_conv[conv]:
            r = min(own, key=lambda r: (r.turn, r.content))
            rows.append((conv, None, r.turn, call, "orphan", len(own), [],
                         text({"call_id": call, "conv_id": conv, "result": r.content, "turn": r.turn})))
    rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[4] == "orphan", r[2], r[3]))
    start: dict = {}
    return [(r[0], i - start.setdefault(r[0], i), *r[1:]) for i, r in enumerate(rows)]


def test_query_on_tool_calls_equals_brute_force(spark):
    calls, results, specs = (t.collect() for t in Q.tool_tables(spark, SF001))
    got = Q.op1_tool_calls(spark, SF001).select("conv_id", "position", "depth", "turn", "call_id", "status", "n_results", "errors", "message")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_tool_rows(calls, results, specs))


def test_every_conversation_row_is_a_call_or_result_with_its_whole_text(spark, tmp_path):
    rows = [(1, 0, "user", "first " * 30), (1, 2, "tool", "other role"), (1, 3, None, "no role"), (1, None, "user", "no turn"),
            (1, 4, "system", "rules"), (2, 0, "system", "sys"), (2, 1, "user", "asks")]
    rows += [(3, 2 * i + 1, "assistant", "".join(f'w{k} "{{é}}\\' for k in range(40)) + "x" * i) for i in range(21)]
    rows += [(3, 2 * i + 2, "user", f"answer {i}") for i in range(20)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    d.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [json.loads(r.message) for r in Q.op1_tool_calls(spark, str(tmp_path)).collect()]
    held = []
    for m in got:
        own = m.get("arguments", {})
        held += [own.get("query", own.get("note"))] if "arguments" in m else []
        held += [json.loads(m["arguments_text"] + "}")["query"]] if "arguments_text" in m else []
        held += [m["result"]] if "result" in m else []
    assert sorted(held) == sorted(r[3] for r in rows)
    assert {e for m in got for e in m.get("errors", [])} >= {"not json", "type limit", "missing query"}


def test_empty_tool_tables(spark):
    assert linked(spark, [], []) == []


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(20, 60)} == {7} and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# URL lists -------------------------------------------------------------------

def bare(value):
    """A list value's host without its port."""
    return value.lower().partition("]")[0] + "]" if value.startswith("[") else value.lower().split(":")[0]


def brute_judge(url, day, changes):
    rest = url.split("//", 1)[-1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    host = host.partition("]")[0] + "]" if host.startswith("[") else host.split(":")[0].rstrip(".")
    path = ("/" + path).rstrip("/") if path else ""
    entries = collections.defaultdict(dict)
    for lst, effect, kind, value, action, when in changes:
        h, _, p = value.rstrip("/").partition("/")
        value = bare(h) + (f"/{p}" if p else "")
        entries[lst, effect, kind, value].setdefault(when, set()).add(action)
    best, n = None, 0
    for (lst, effect, kind, value), days in entries.items():
        past = [d for d in days if d <= day]
        if not past or "remove" in days[max(past)]:
            continue
        if kind == "prefix":
            h, _, p = value.partition("/")
            key, p = bare(h), ("/" + p).rstrip("/") if p else ""
            hit, depth = host == key and (path + "/").startswith(p + "/"), p.count("/")
        elif kind == "host":
            hit, depth = host == bare(value), 0
        else:
            hit, depth = host == bare(value) or host.endswith("." + bare(value)) and host[0] != "[", bare(value).count(".")
        if hit:
            n += 1
            rank = (["prefix", "host", "domain"].index(kind), -depth, effect, lst)
            best = rank if best is None else min(best, rank)
    return n, best is None or best[2] == "allow"


def test_captures_meet_the_entries_of_their_day(spark):
    r = np.random.default_rng(4)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "other.org", "x.other.org", "localhost", "[2001:db8::1]", "[::ffff:1.2.3.4]"]
    paths = ["", "/", "/x", "/x/y", "/x/yy", "/x/y/z/"]
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=int(n))
    urls = [f"https://u:p@{h.upper()}:80{p}?q=1#f" if r.random() < 0.3 else f"http://{h}{p}" for h in hosts for p in paths]
    urls += [f"{h}:8080{p}" for h in hosts for p in paths] + [f"//{h}{p}" for h in hosts[5:] for p in paths] + [f"ftp://u@{h}:21/x" for h in hosts]
    captures = [(i, urls[r.integers(len(urls))], day(r.integers(0, 100))) for i in range(500)]
    changes = []
    for _ in range(110):
        kind = ["host", "domain", "prefix"][r.integers(3)]
        value = hosts[r.integers(len(hosts))] + ["", "", ":8080"][r.integers(3)] + (paths[r.integers(len(paths))] if kind == "prefix" else "")
        changes.append((f"l{r.integers(3)}", ["block", "allow"][r.integers(2)], kind, value, ["add", "remove"][int(r.random() < 0.4)],
                        day(r.integers(0, 100))))
    odd = [(900, None, day(1)), (901, "http://", day(1)), (902, "http://other.org", None), (None, "http://other.org", day(99))]
    bad = [("l0", "block", "host", None, "add", day(0)), ("l0", "block", "planet", "other.org", "add", day(0)), (None, "block", "host", "other.org", "add", day(0))]
    c = spark.createDataFrame(captures + odd, "page_id long, url string, fetched date").withColumn("key", F.lit("x")).withColumn("uid", F.lit(1))
    h = spark.createDataFrame(changes + bad, "list string, effect string, kind string, value string, action string, day date")
    got = judge(c, h).collect()
    assert len(got) == len(captures) + len(odd)
    rows = {r.page_id: r for r in got}
    for i, url, when in [*captures, odd[3]]:
        assert (rows[i].n_active, rows[i].kept) == brute_judge(url, when, changes), url
    assert all(rows[i].kept and rows[i].n_active == 0 for i in (900, 901, 902))
    assert judge(c, h.limit(0)).where("kept").count() == len(got) and judge(c.limit(0), h).count() == 0


@pytest.mark.parametrize(("url", "host", "path"), [
    ("example.com:8080/x", "example.com", "/x"), ("localhost:80", "localhost", ""), ("http://[2001:db8::1]/a", "[2001:db8::1]", "/a"),
    ("http://u:p@[::1]:8080/a/?q", "[::1]", "/a"), ("HTTP://Ex.COM./", "ex.com", ""), ("//h/x", "h", "/x"), ("a+b.c-1://h:1", "h", "")])
def test_forms_of_a_url_have_one_host(spark, url, host, path):
    from barflow.llm.url_lists import host_of, path_of
    d = spark.createDataFrame([(url,)], "u string")
    assert tuple(d.select(host_of(F.col("u")), path_of(F.col("u"))).first()) == (host, path)


# vectors ---------------------------------------------------------------------

def brute_nearest(ids, x, q, k):
    s = x @ x[list(ids).index(q)]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_recall_on_the_table(spark):
    d = spark.read.parquet(f"{SF01}/embeddings.parquet")
    p = d.toPandas()
    ids, x = p["vec_id"].to_numpy(), np.array(p["embedding"].tolist(), dtype=float)
    got = Q.op7_multi_index(spark, SF01).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        exp = brute_nearest(ids, x, q, 20)
        assert own["rank"].tolist() == list(range(1, 21))
        assert own["score"].to_numpy() == pytest.approx(x[[list(ids).index(v) for v in own["vec_id"]]] @ x[list(ids).index(q)], abs=1e-12)
        hit += len({v for v, _ in exp} & set(own["vec_id"]))
        total += len(exp)
    assert hit / total >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=5).tolist()) for i in range(30)] + [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(60)]
    bad = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [1.0, 2.0]),
           (None, [1.0] * 5), (205, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (206, [])]
    d = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>").withColumn("h", F.lit("x")).withColumn("cell", F.lit(1))
    got = collections.defaultdict(list)
    for x in MultiIndex(d, k=7).search(d, probe=10**6).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert set(got) == set(ids.tolist())
    for q in ids.tolist():
        assert got[q] == [v for v, _ in brute_nearest(ids, x, q, 7)]
    none = d.limit(0)
    assert MultiIndex(none).search(none).count() == 0 and MultiIndex(d).search(none).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert MultiIndex(few).search(few).count() == 4 * 3


def test_cells_come_by_rising_distance():
    r = np.random.default_rng(5)
    a, b, count = r.random(9), r.random(9), r.integers(0, 3, 81)
    cells = visit(a, b, count, 10**9)
    total = [a[c // 9] + b[c % 9] for c in cells]
    assert total == sorted(total) and set(cells) == set(np.flatnonzero(count).tolist())
    short = visit(a, b, count, 5)
    assert short == cells[:len(short)] and count[short].sum() >= 5 > count[short[:-1]].sum()


# pipeline and SQL ------------------------------------------------------------

def test_pipeline_stages_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, "src1", 0) for i, t in enumerate([None, "", "123 %%%", "one two three"])], d.schema)
    docs = d.unionByName(extra)
    kept = cut(corpus_pipeline.STAGES[0][1](spark, docs, SF001), "t0")
    rows = docs.collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if any(c.isalpha() for c in r.text or ""))
    named = {r.doc_id: r.lang for r in rows}
    assert all(r.lang == named[r.doc_id] for r in kept.collect() if named[r.doc_id])
    rows = kept.collect()
    kept = cut(corpus_pipeline.STAGES[1][1](spark, kept, SF001), "t1")
    best: dict = {}
    for r in rows:
        k = "".join(r.text.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(v[1] for v in best.values())
    rows = [tuple(r) for r in kept.collect()]
    kept = cut(corpus_pipeline.STAGES[2][1](spark, kept, SF001), "t2")
    exp = sorted(r[0] for r, v in zip(rows, H.components(rows, 5, 80).values(), strict=True) if r[0] == v[1])
    assert sorted(r.doc_id for r in kept.collect()) == exp
    mixed = cut(corpus_pipeline.STAGES[3][1](spark, kept, SF001), "t3")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == d.columns
    assert copies == +collections.Counter(H.whole_copies(Q.mix_sources(kept).collect()))
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF001).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_language_stage_keeps_an_unlabelled_table(spark):
    docs = H.clashing(spark).withColumn("lang", F.lit(None).cast("string"))
    got = collections.Counter(tuple(r) for r in corpus_pipeline.language_stage(spark, docs, SF001).select("doc_id", "text").collect())
    assert got == collections.Counter((r[0], r[1]) for r in H.odd_documents() if any(c.isalpha() for c in r[1] or ""))
    assert corpus_pipeline.language_stage(spark, docs, SF001).columns == docs.columns


def test_language_stage_names_the_language_of_unlabelled_documents(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").where("lang is not null")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    docs = d.withColumn("lang", F.when(~hidden, F.col("lang")))
    got = corpus_pipeline.language_stage(spark, docs, SF01).select("doc_id", "lang").join(d.select("doc_id", F.col("lang").alias("own"), hidden.alias("hidden")), "doc_id")
    rows = got.collect()
    assert all(r.lang == r.own for r in rows if not r.hidden)
    asked = [r.lang == r.own for r in rows if r.hidden]
    assert len(asked) > 200 and sum(asked) / len(asked) > 0.97 and len({r.lang for r in rows}) >= 4


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_maps_clashing_names_and_empty_tables(spark, stage):
    docs = H.clashing(spark).withColumn("meta", F.create_map(F.lit("k"), F.col("source"), F.lit("b"), F.lit("v"))) \
        .withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.create_map(F.lit("x"), F.col("doc_id"))).alias("m")))) \
        .withColumn("none", F.lit(None).cast("map<string,int>"))
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, SF001)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    plain = docs.drop("meta", "deep", "none")
    key = lambda d: collections.Counter((r.doc_id, r.text) for r in d.collect())
    assert key(out) == key(run(spark, plain, SF001)) and all(r.meta["b"] == "v" for r in out.collect())
    assert run(spark, docs.limit(0), SF001).count() == 0


def test_pipeline_runs_and_keeps_columns(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join",
                                                      "mixing sources to target weights", "best-fit packing"]
    assert li.UNDETERMINED == "und"


@pytest.mark.parametrize("name", [k for k, (_, sql) in Q.REGISTRY.items() if sql])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    s, d = Q.REGISTRY[name][0](spark, SF001).toPandas(), con.execute(Q.REGISTRY[name][1]).df()
    assert sorted(s.columns) == sorted(d.columns) and digest(norm(s)) == digest(norm(d))
