"""The operators beside brute force on small fixtures, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import itertools
import json
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logbasin.llm import ann, exact_topk, line_dedup, minhash, mixing, pieces, quality, secret_scan, sharding, tool_calls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a line that many documents hold, well over forty characters"
EXTRA = ["gone", "kept_lines", "doc_key", "copy", "word_size", "plan_copies", "kept_id", "row_key", "quality_score", "text_words", "h1", "rep", "cell", "unit"]


def make(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"src{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def crowded(df):
    """With columns named as the operators name their own."""
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words, 120))
    texts = [None, "", " \t\n", "one two", f"{LONG}\nown\n{LONG}", f"  {LONG.upper()}\t\nx", f"{LONG}", f"{LONG}\n", f"q\n{LONG}", base, base, base.upper()]
    for _ in range(6):
        near = base.split()
        near[int(rng.integers(120))] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 60, 20)]
    texts.append(" ".join(rng.choice(words, 20_000)))
    frame = make(spark, texts)
    return frame.unionByName(frame.where("doc_id in (5, 9)")).unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], SCHEMA))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- line dedup -----------------------------------------------------------------------


def lines_by_hand(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    held = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if i is not None and len(k) >= 40:
                held[k].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if i is None or k not in gone or gone[k] == i]
        out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    return Counter(out)


def test_line_dedup(spark, docs):
    found = line_dedup.dedup_lines(crowded(docs))
    assert set(EXTRA) <= set(found.columns)
    got = Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in found.collect())
    assert got == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_keeps_texts_of_one_id_apart_and_text_ids(spark):
    """One doc_id with two texts loses its lines at other places in each; ids of text are compared as text."""
    rows = [(f"d{i}", f"{LONG}\n{i}") for i in range(5)] + [("d1", f"a\n{LONG}\n{LONG}"), ("d1", f"a\n{LONG}\n{LONG}"), (None, LONG)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter(tuple(r) for r in got) == lines_by_hand(rows)


def test_line_dedup_is_linear_in_a_text(spark, tmp_path):
    """Twice the frequent lines of five texts take about twice the time; every one of them goes from four texts."""

    def seconds(n):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n) + F.col("id") * 0), lambda i: F.concat(F.lit(LONG), i.cast("string"))), "\n")
        spark.range(5).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / str(n)))
        frame = spark.read.parquet(str(tmp_path / str(n)))
        start = time.monotonic()
        found = {r.doc_id: (r.n_lines, r.n_dropped, r.size) for r in line_dedup.dedup_lines(frame).select("*", F.length("text").alias("size")).collect()}
        took = time.monotonic() - start
        assert all(found[i] == (n, n, 0) for i in range(4)) and found[4][:2] == (n, 0) and found[4][2] > n * len(LONG)
        return took

    seconds(1_000)
    assert seconds(100_000) < 2.5 * seconds(50_000)


def test_line_runs_compact_and_find_the_unseen(spark):
    batch = lambda *texts: line_dedup.line_hashes(make(spark, texts), 1)
    runs = line_dedup.LineRuns(spark, fanout=2)
    for texts in (("a",), ("b",), ("c", "a")):
        runs.add(batch(*texts))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert runs.entries().count() == 3
    assert runs.unseen(batch("a", "z")).count() == 1
    runs.compact()
    assert sum(len(x) for x in runs.levels) == 1 and runs.entries().agg(F.sum("n_docs")).first()[0] == 4


# -- neighbours ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(600, 8)).astype(np.float32)
    m[100:300] = m[100]  # a third is one vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)]
    rows += [(600, None, 1), (650, [0.0] * 8, 1), (700, [1.0, None] + [0.0] * 6, 1), (750, [float("nan")] + [1.0] * 7, 1), (800, [float("inf")] + [1.0] * 7, 1), (850, [], 1), (900, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), m


def test_neighbours_reach_the_recall(vectors):
    frame, m = vectors
    got = defaultdict(list)
    for r in ann.search(frame.withColumn("list", F.lit(1)), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.sort(s)[::-1][:5]
        assert [x for _, x in got[q]] == sorted((x for _, x in got[q]), reverse=True)
        hit += sum(x >= best[-1] - 1e-9 for _, x in got[q])
        total += 5
    assert set(got) == set(range(0, 600, 50)) and hit / total >= 0.9
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]


def test_the_ratio_alone_decides_on_the_lists_of_a_query(spark):
    """Without clusters the ratio admits hundreds of lists: all of them are read."""
    m = np.random.default_rng(12).normal(size=(4700, 64))
    c = ann.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m[:4000])], "vec_id long, vector array<double>"), list_rows=8)
    asked = ann.unit(m[4000:])
    row, lists = ann.query_lists(c, asked, 1.25, 8)
    d = np.sqrt(np.maximum(2 - 2 * asked @ c.points.T, 0))
    want = d <= 1.25 * d.min(1, keepdims=True) + 1e-12
    got = np.zeros_like(want)
    got[row, lists] = True
    wide = want.sum(1) > 2 * ann.BEAM
    assert len(c.points) > 400 and wide.mean() > 0.3 and len(row) == got.sum()
    assert (got[wide] == want[wide]).all() and (got & want).sum() >= 0.99 * want.sum()


def test_exact_topk(vectors):
    frame, m = vectors
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(frame.withColumn("grp", F.lit(1)), F.col("vec_id") % 100 == 0, 10, block=128).collect()]
    x = np.floor(1024 * np.vstack([m.astype(float), np.zeros((1, 8))])).astype(np.int64)
    ids = np.array([*range(600), 650])  # the zero vector takes part here
    want = []
    for q in range(0, 600, 100):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
        want += [(q, k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert sorted(got) == want


def test_elimination_leaves_candidates_out():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 16)) * 100
    x = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(size=(4000, 16)))
    ids, pivots, seen = np.arange(4000), x[::100], []
    q, v, s = exact_topk.search_block(ids[:5], x[:5], ids, x, pivots, 3, exact_topk.pivot_distances(x, pivots), seen)
    full = (x @ x[:5].T).astype(int)
    for i in range(5):
        full[i, i] = -(10**9)
        assert sorted(s[q == i], reverse=True) == sorted(full[:, i], reverse=True)[:3]
    assert sum(seen) < 5 * 4000 / 2


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, F.lit(True)).count() == 0
    assert exact_topk.top_k(none, F.lit(True)).count() == 0


# -- tool calls -------------------------------------------------------------------------------


def test_tool_calls(spark):
    call = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "lookup", '{"query": "x\\"y", "limit": 3}', ["b"]), (1, 3, "b", "measure", '{"words": "many"}', []),
            (1, 5, "c", "lookup", '{"limit": 1, "more": 2}', ["d"]), (1, 7, "d", "reply", "[1]", ["c"]),
            (1, 9, "e", "other", "{}", ["nowhere"]), (2, 1, "a", "reply", '{"text": "hi", "final": true}', None),
            (2, 3, "a", "reply", None, None), (2, 5, None, "reply", "{}", None),
        ],
        call,
    )
    results = spark.createDataFrame([(1, 2, "a", "r1"), (1, 4, "b", ""), (3, 1, "z", "lost"), (2, 6, None, "x")], "conv_id long, turn long, call_id string, result string")
    rows = tool_calls.link(calls, results, tool_calls.tools(spark)).collect()
    by = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == 10
    assert by[1, "a", 1].json == '{"arguments":{"limit":3,"query":"x\\"y"},"id":"a","name":"lookup","result":"r1"}'
    assert [by[1, k, t].place for k, t in (("b", 3), ("e", 9), ("a", 1))] == [0, 1, 2]
    assert (by[1, "a", 1].level, by[1, "b", 3].level, by[1, "c", 5].level) == (1, 0, None)
    assert by[1, "b", 3].errors == ["type:words"] and by[1, "c", 5].errors == ["missing:query", "unknown:more"]
    assert by[1, "d", 7].errors == ["not_an_object"] and by[1, "e", 9].errors == ["unknown_tool", "missing_reference"]
    assert Counter(r.status for r in rows) == {"linked": 2, "unanswered": 4, "ambiguous": 2, "orphan": 2}
    assert tool_calls.link(calls.limit(0), results.limit(0), tool_calls.tools(spark)).count() == 0


def test_arguments_keep_their_json_types(spark):
    fields = [("n", "integer", False), ("s", "string", False), ("x", "number", False), ("o", "object", False), ("l", "array", False), ("b", "boolean", False)]
    schemas = spark.createDataFrame([("t", fields)], tool_calls.tools(spark).schema)
    cases = [
        ("t", '{"n": "5", "s": 5, "x": 7, "b": "true"}', "type:b,type:n,type:s", '{"b":"true","n":"5","s":5,"x":7}'),
        ("t", '{"n": "007", "x": 1.50e+2, "o": [], "l": {}}', "type:l,type:n,type:o", '{"l":{},"n":"007","o":[],"x":1.50e+2}'),
        ("t", '{"o": {"z": {"b": [1.0, {"d": -0.10, "c": null}], "a": "n1"}, "y": "s\\"2\\" 3"}, "n": 1.5}', "type:n",
         '{"n":1.5,"o":{"y":"s\\"2\\" 3","z":{"a":"n1","b":[1.0,{"c":null,"d":-0.10}]}}}'),
        ("none", '{"k": 123456789012345678901234567890123456789012345, "a": false}', "unknown_tool", '{"a":false,"k":123456789012345678901234567890123456789012345}'),
        ("t", "{}", "", "{}"), ("t", '{"n": 1} {"n": 2}', "not_an_object", "null"), ("t", '{"n": 01}', "not_an_object", "null"),
        ("t", '{"s": "' + "long \\\\ text 1 " * 20_000 + '"}', "", '{"s":"' + "long \\\\ text 1 " * 20_000 + '"}'),
    ]
    rows = [(1, i, f"c{i}", name, raw, None) for i, (name, raw, _, _) in enumerate(cases)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, result string")
    got = {r.turn: r for r in tool_calls.link(calls, results, schemas).collect()}
    for i, (_, _, errors, canon) in enumerate(cases):
        assert ",".join(got[i].errors) == errors
        assert got[i].json.startswith('{"arguments":' + canon + ',"id":')


def test_derived_calls_hold_whole_texts_and_chain(spark):
    long = 'said "so"\n\t\\ ' * 300 + "end"
    turns = [(1, i, "user" if i % 2 else "assistant", f"{i} {long}") for i in range(80)] + [(2, 1, "assistant", None)]
    calls, results = tool_calls.from_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = {(r.conv_id, r.turn): r for r in tool_calls.link(calls, results, tool_calls.tools(spark)).collect() if r.name}
    assert len(rows) == 41 and rows[2, 1].level == 0
    for i in range(0, 80, 2):
        r, given = rows[1, i], json.loads(rows[1, i].json)["arguments"]
        assert (r.level, r.place) == (i // 2, i // 2) and f"{i} {long}" in (given.get("query"), given.get("text"))
        assert ("unknown_tool" in r.errors, "missing_reference" in r.errors) == (i % 7 == 5, i % 7 == 6)
        assert ("type:limit" in r.errors) == (i % 7 == 3 and i % 3 == 0 and i % 7 != 5)


def test_levels_of_random_graphs(spark):
    rng = np.random.default_rng(13)
    n = 60
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (55, 2)) if a > b} | {(i, i - 1) for i in range(101, 140)} | {(150, 151), (151, 150), (152, 151), (153, 152), (153, 3), (139, 40)}
    names = {*range(n), *range(100, 140), 150, 151, 152, 153}
    want: dict = {}
    for _ in names:
        for x in names - set(want):
            needs = [b for a, b in edges if a == x]
            if all(b in want for b in needs):
                want[x] = max((want[b] + 1 for b in needs), default=0)
    calls = spark.createDataFrame([(1, str(x)) for x in names], "conv_id long, call_id string")
    given = spark.createDataFrame([(1, str(a), str(b)) for a, b in edges], "conv_id long, call_id string, needs string")
    got = tool_calls.levels(calls, given).collect()
    assert {int(r.call_id): r.level for r in got} == want and len(got) == len(want) < len(names)


# -- secrets ------------------------------------------------------------------------------------


def test_secret_scan_tells_tokens_from_words(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "short"]
    for i in range(120):
        h = "".join(rng.choice(list("0123456789abcdef"), 40))
        texts.append(f'some words token = "{h}" more words' if i % 2 else f"plain text with wordsgluedtogetherhere number{i} and commit {h} noted")
    frame = make(spark, texts)
    found = secret_scan.scan(frame.unionByName(frame.where("doc_id = 4")), F.col("doc_id") % 5 != 0).collect()
    assert all(r.secret == ("token = " in r.before and len(r.candidate) == 40) for r in found)
    assert sum(r.secret for r in found) == 61
    assert secret_scan.scan(empty(spark)).count() == 0


def test_a_secret_may_stand_in_any_occurrence(spark):
    rng = np.random.default_rng(14)
    texts, late = [], set()
    for i in range(150):
        h = "".join(rng.choice(list("0123456789abcdef"), 40))
        texts.append(f"plain text and commit {h} noted" + (f' then words, much later token = "{h}" and more' if i % 3 == 0 else f" and commit {h} again" if i % 3 == 1 else ""))
        late |= {i} if i % 3 == 0 else set()
    found = {r.doc_id: r for r in secret_scan.scan(make(spark, texts), F.col("doc_id") % 5 != 0).collect()}
    assert len(found) == 150 and {i for i, r in found.items() if r.secret} == late
    assert [found[i].occurrences for i in (0, 1, 2)] == [2, 2, 1] and found[0].before.endswith('token = "')


def test_neighbourhoods_are_those_of_the_text(spark):
    c = "abcdefgh01234567"
    texts = [f"{c} x{c}y/{c} é{c}\n{c}!{c}!{c}!{c}", c, "short", f"{'w ' * 100}{c}.{'ü ' * 100}{c}"]
    got = [(r.doc_id, r.place, r.candidate, r.before, r.after) for r in secret_scan.candidates(make(spark, texts)).collect()]
    want = []
    for i, t in enumerate(texts):
        want += [(i, k, m.group(), t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 48]) for k, m in enumerate(re.finditer(secret_scan.CANDIDATE, t))]
    assert sorted(got) == want


# -- quality --------------------------------------------------------------------------------------


def test_quality_rules(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) + ("." if i % 3 else "!! | " * 30) for i in range(300)]
    frame = make(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(301, None)], "doc_id long, quality int")
    rows = quality.score_documents(frame.unionByName(frame.where("doc_id = 3")), labels).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    kept = quality.filter_good(crowded(frame), labels)
    assert kept.columns == [*frame.columns, *EXTRA] and kept.where("doc_id < 300").count() == 200
    assert {r.score for r in quality.score_documents(frame, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(empty(spark), labels).count() == 0


def test_quality_rules_are_sparse(spark):
    rules = quality.Rules(0.0, ((((0, True, 1.5), (1, False, 2.0)), 1.0),))
    frame = quality.with_statistics(make(spark, ["ab", "abc def ghi jkl mno"]))
    assert [round(r[0], 3) for r in frame.select(rules.score()).collect()] == [0.5, 0.5]


# -- sharding ---------------------------------------------------------------------------------------


def test_sharding(spark, docs):
    rows = sharding.shard_documents(crowded(docs), n_shards=4, n_slots=256).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    heaviest = max(r.size for r in rows)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) <= max(heaviest, 2 * min(loads.values()))
    assert sharding.shard_documents(empty(spark), 4, 16).count() == 0


def shards_by_hand(rows, given, n_shards):
    """Sizes, checksums and gapless places as the texts give them; the bytes of each shard and the shards of each text."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    loads, places, texts = [0] * n_shards, defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        texts[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return loads, texts


def test_repeated_rows_and_equal_texts_keep_the_law(spark):
    """2,000 equal rows, 500 documents of one text, 700 empty ones, and pairs of equal texts that stay together."""
    given = [(7, "the same row " * 4)] * 2000 + [(i, "one text " * 9) for i in range(1000, 1500)] + [(None, None)] * 300 + [(i, "") for i in range(400)]
    given += [(3000 + i, f"text of a pair {i // 2}") for i in range(1200)]
    loads, texts = shards_by_hand(sharding.shard_documents(make_pairs(spark, given)).collect(), given, 16)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 16
    pairs = [s for i in range(600) if (s := texts[len(f"text of a pair {i}") + 1, zlib.crc32(f"text of a pair {i}".encode())])]
    assert len(pairs) == 600 and all(len(s) == 1 for s in pairs)
    assert len(texts[1, 0]) > 1 and len(texts[53, zlib.crc32(given[0][1].encode())]) == 16


def make_pairs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rebalancing_moves_few_slots(spark):
    loads = spark.createDataFrame([(s, 100 + s % 7, 1) for s in range(64)], "virtual_slot int, bytes long, records long")
    slots = sharding.SlotMap(spark, n_slots=64)
    slots.build(loads, 4)
    before = {r.virtual_slot: r.shard for r in slots.read(0).collect()}
    after = {r.virtual_slot: r.shard for r in slots.rebalance(loads, 5).collect()}
    moved = [s for s in before if before[s] != after[s]]
    assert slots.version == 1 and all(after[s] == 4 for s in moved) and 10 <= len(moved) <= 14
    fewer = {r.virtual_slot: r.shard for r in slots.rebalance(loads, 3).collect()}
    assert set(fewer.values()) == {0, 1, 2}


# -- near duplicates -----------------------------------------------------------------------------------


def near_by_hand(rows, words, threshold=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        sets.append((i, s))
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(sets, 2):
            if i is not None and j is not None and a and b and label[i] != label[j] and 100 * len(a & b) >= threshold * len(a | b):
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return {(i, len(s), label.get(i)) for i, s in sets}


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = minhash.near_duplicates(crowded(docs), words=4, block=3, cell=2).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == near_by_hand(rows, 4)
    kept = minhash.keep_one(crowded(docs))
    want = {i for i, _, c in near_by_hand(rows, 5) if i == c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_a_group_of_chained_variants(spark):
    """Neighbours are similar, ends are not: only all links together make one component."""
    rng = np.random.default_rng(6)
    text = [f"v{i}" for i in range(200)]
    chain = []
    for k in range(60):
        text[k * 3] = f"new{k}"
        chain.append(" ".join(text))
    rng.shuffle(chain)
    rows = list(enumerate(chain))
    found = minhash.near_duplicates(make(spark, chain), words=4, block=8, cell=1).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == near_by_hand(rows, 4)


def test_components_of_random_edges(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (50, 2)) if a != b]
    label = {i: i for p in pairs for i in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {(r.u, r.v) for r in minhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(i, c) for i, c in label.items() if i != c}


# -- pieces ----------------------------------------------------------------------------------------------


def test_pieces_round_trip_and_reruns(spark, docs):
    odd = make(spark, ["a  b\n\n c▁d \t\r\n", "日本語 😀é", "x" * 5000, "   ", "\n", None, ""])
    for frame in (docs, odd):
        coded = pieces.decode(pieces.encode(crowded(frame)))
        assert coded.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
        again = pieces.encode(frame.repartition(3)).groupBy("doc_id", "text", "ids").count()
        assert again.join(coded.select("doc_id", "ids").distinct(), ["doc_id", "ids"], "left_anti").where("doc_id is not null and ids is not null").count() == 0
    assert pieces.encode(empty(spark)).count() == 0


def test_pieces_follow_the_lattice():
    lattice = pieces.Lattice(pieces.Vocabulary(pieces.MODEL, 1.0))
    by_text = {p.replace(pieces.SPACE, " "): i for i, p in enumerate(lattice.v.pieces) if i >= 259}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in by_text:
                yield from ((by_text[s[:k]], *rest) for rest in ways(s[k:]))

    every = list(ways(" thin"))
    weight = np.array([np.exp(sum(lattice.v.weight[i] for i in w)) for w in every])
    n = 40_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.sample_texts(lattice, [" thin"] * n, pieces.mixed(np.arange(n, dtype=np.uint64))))
    assert set(drawn) <= set(every)
    assert max(abs(drawn[w] / n - p) for w, p in zip(every, weight / weight.sum(), strict=True)) < 0.01


def test_pieces_compare_chunks_and_decode_any_ids(monkeypatch):
    vocabulary = pieces.Vocabulary(pieces.MODEL, 1.0)
    texts, keys = ["a fine day\n\n", None, "", "a  fine dog 😀"] * 20, np.arange(80, dtype=np.uint64)
    want = pieces.sample_texts(pieces.Lattice(vocabulary), texts, keys)
    by_bytes = pa.array(pieces.piece_bytes(pieces.MODEL), pa.binary())
    lists = pa.array([None if x is None else x.tolist() for x in want], pa.list_(pa.int32()))
    assert pieces.decode_ids(by_bytes, lists).to_pylist() == texts
    assert pieces.decode_ids(by_bytes, lists.slice(1, 2)).to_pylist() == [None, ""]
    broken = int(vocabulary.byte_ids[0xF0])
    assert pieces.decode_ids(by_bytes, pa.array([[broken]], pa.list_(pa.int32()))).to_pylist() == ["\ufffd"]
    # All hashes alike: only the comparison of characters tells chunks apart.
    monkeypatch.setattr(pieces, "chunk_hashes", lambda points, starts, sizes: np.ones(len(starts), np.uint64))
    alike = pieces.sample_texts(pieces.Lattice(vocabulary), texts, keys)
    assert all((a is None and b is None) or a.tolist() == b.tolist() for a, b in zip(want, alike, strict=True))


# -- mixing ------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = np.random.default_rng(8)
    sources = [str(rng.choice(["a", "b", "c", "d"], p=[0.1, 0.6, 0.2, 0.1])) if i % 50 else None for i in range(900)]
    frame = make(spark, [" ".join(["w"] * int(n)) if n else None for n in rng.integers(0, 60, 900)], sources)
    frame = frame.unionByName(frame.where("doc_id in (3, 4)"))
    plan = mixing.plan_copies(crowded(frame), fan_in=16).collect()
    total, names = Counter(), ["a", "b", "c", "d", None]
    for r in plan:
        total[r.source] += r.size * r.rows
        assert 0 <= r.copies <= 2 and (r.size or not r.copies)
    weight = dict(zip(names, [3, 1, 2, 3, 1], strict=True))
    want, capped = 1.5 * sum(total.values()), {}
    while True:
        left = [n for n in names if n not in capped]
        level = (want - sum(capped.values())) / sum(weight[n] for n in left)
        over = {n: 2.0 * total[n] for n in left if level * weight[n] > 2 * total[n]}
        if not over:
            break
        capped |= over
    target = {n: capped.get(n, level * weight[n]) for n in names}
    taken = Counter()
    for r in plan:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.size * r.rows * r.copies
    assert all(abs(taken[n] - target[n]) <= 60 for n in names)
    again = mixing.plan_copies(frame.repartition(5), fan_in=16).collect()
    assert {(r.doc_id, r.copies) for r in plan} == {(r.doc_id, r.copies) for r in again}
    assert mixing.mix(crowded(frame), fan_in=16).count() == sum(r.copies * r.rows for r in plan)
    assert mixing.plan_copies(empty(spark)).count() == 0 and mixing.plan_copies(make(spark, [None, ""])).count() == 2
