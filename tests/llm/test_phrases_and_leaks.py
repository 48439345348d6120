"""Collocations, importance resampling and decontamination beside brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logbasin.llm import collocations, decontaminate, importance, quotient

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}
CLASHING = ["row", "doc", "words", "passed", "pos", "len", "window", "hashes_10", "_p1", "chunk", "line", "bucket", "weight", "score", "rank", "cells", "n_words", "place", "left", "lead"]


def crowded(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)


# -- quotient filters -----------------------------------------------------------------


@pytest.mark.parametrize("n,width", [(2, 2), (2, 18), (3, 6), (3, 18), (4, 18), (4, 32)])
def test_ids_come_back_from_packed_and_permuted_keys(n, width):
    rng = np.random.default_rng(n * width)
    ids = [rng.integers(0, 1 << width, 500, dtype=np.uint64) for _ in range(n)]
    half = n * width // 2
    left, right = quotient.packed_ids(ids, width)
    assert int(left.max()) < 1 << half and int(right.max()) < 1 << half
    moved = quotient.permuted(left, right, half)
    assert int(moved[0].max()) < 1 << half and int(moved[1].max()) < 1 << half
    back = quotient.unpacked_ids(*quotient.restored(*moved, half), n, width)
    assert all((a == b).all() for a, b in zip(ids, back))


def test_the_permutation_hits_every_key_once():
    all_keys = np.arange(1 << 8, dtype=np.uint64)
    moved = quotient.permuted(all_keys >> np.uint64(4), all_keys & np.uint64(15), 4)
    assert len(set(zip(*[m.tolist() for m in moved]))) == 1 << 8


@pytest.mark.parametrize("half", [2, 4, 18, 33, 64])
def test_filters_keep_every_count_through_packing_and_merging(half):
    rng = np.random.default_rng(half)
    top = min(1 << half, 40)
    held, want = quotient.Merger(half), Counter()
    prefix = quotient.prefix_bits(3, half)
    for size in (1, 5, 700, 3, 900, 0):
        left, right = (rng.integers(0, top, size, dtype=np.uint64) << np.uint64(half - min(half, 6)) for _ in range(2))
        want.update(zip(left.tolist(), right.tolist()))
        entries = quotient.counted(left, right, half)
        for p, part in quotient.by_prefix(entries, half, prefix):
            held.add(quotient.unpack(quotient.pack(part, half, prefix), p, half, prefix))
    found = held.take()
    assert dict(zip(zip(*[x.tolist() for x in quotient.restored(found.left, found.right, half)]), found.count.tolist())) == want


def test_counters_pass_one_byte():
    left = np.repeat(np.array([1, 2, 3], np.uint64), [254, 255, 100_000])
    entries = quotient.counted(left, left, 8)
    total = quotient.merged([quotient.unpack(quotient.pack(e, 8, 1), p, 8, 1) for p, e in quotient.by_prefix(entries, 8, 1)], 8)
    assert sorted(total.count.tolist()) == [254, 255, 100_000]


# -- collocations ---------------------------------------------------------------------


def collocations_by_hand(rows, least, longest, first):
    f, spoken = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\f\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            spoken[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        judged = []
        for g, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            longer = [b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                judged.append((lang, " ".join(g), a, counts[g[:k]], counts[g[k:]], spoken[lang], score))
        judged.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(judged[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = np.random.default_rng(5)
    words = ["ab", "Ça", "é", "x y", "of", "the", "New", "YORK", "city", "-"] + [f"w{i}" for i in range(30)]
    odds = np.array([1.0 / (i + 1) for i in range(len(words))])
    rows = [(1, None, "en"), (2, "", None), (3, " .,;\t\n", "en"), (None, "of the of the of the", None), (4, "of the. of the! of\nthe", "und")]
    for i in range(120):
        text = "".join(w + str(s) for w, s in zip(rng.choice(words, 60, p=odds / odds.sum()), rng.choice([" ", "  ", "\t", ". ", ",", "\r\n"], 60, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])))
        rows.append((10 + i, text + " new york city hall", ["en", "de", None][i % 3]))
    rows += [rows[-1]] * 7
    rows.append((900, " ".join(rng.choice(words, 30_000, p=odds / odds.sum())), "en"))
    return rows


@pytest.mark.parametrize("least,longest,first", [(5, 4, 2000), (3, 3, 17), (8, 2, 5)])
def test_collocations_equal_brute_force(spark, phrases, least, longest, first):
    found = collocations.collocations(crowded(frame(spark, phrases)), least, longest, first).collect()
    want = collocations_by_hand(phrases, least, longest, first)
    assert len(want) > 10
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found) == want


def test_a_hot_pair_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_ENTRIES", 4)
    rows = [(i, "hot pair " * 400 + "; cold", "en") for i in range(40)]
    found = collocations.collocations(frame(spark, rows).repartition(5), 30, 2, 10).collect()
    assert [(r.phrase, r.a) for r in found] == [("hot pair", 16_000), ("pair hot", 15_960)]


def test_a_task_counts_many_phrases_in_bounded_memory():
    rng, half = np.random.default_rng(5), 18
    chunks = ((rng.integers(0, 1 << half, 300_000, dtype=np.uint64), rng.integers(0, 1 << half, 300_000, dtype=np.uint64)) for _ in range(10))
    tracemalloc.start()
    sent = sum(len(quotient.unpack(f.as_py(), p.as_py(), half, 8)) for b in collocations.filters_of(chunks, half, 8) for p, f in zip(*b.columns))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # With the two million entries held before: 206 MB.
    assert sent >= 2_990_000 and peak < 100e6


def test_chunks_end_where_pieces_end():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc .,;\t\n"), 5000))
    texts = pa.array([text, None, "", "x", text[::-1]])
    data, begins = collocations._text_bytes(texts)
    begins = np.unique(begins[begins < len(data)])
    kind = collocations.KIND[data]

    def pieces(limit):
        out, start = [], 0
        for stop in collocations._cuts(kind, begins, limit):
            found = collocations.chunk_words(data[start:stop], kind[start:stop], begins[(begins >= start) & (begins < stop)] - start)
            start = stop
            if found:
                words, line = [None, *found[0].to_pylist()], found[1].tolist()
                out += [p for p in " ".join(words[i] or "|" for i in line).split("|")]
        return [p.strip() for p in out if p.strip()]

    whole = [" ".join(p.split()) for t in (text, "x", text[::-1]) for p in re.split("[.,;\n]", t)]
    assert pieces(1 << 20) == pieces(64) == pieces(1) == [p for p in whole if p]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " . ", "en")]), 1).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5_000_000_000_000_000_000
    ids = "n int, i1 long, i2 long, i3 long, i4 long, a long"
    pairs = spark.createDataFrame([(2, 1, 2, 0, 0, big - 3)], ids)
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big + 1, 2)], "lang string, word string, f long, id long")
    assert collocations.scored(pairs, words).first().score == 2_000_000 * (big - 3) // (2 * big + 1)


# -- importance -----------------------------------------------------------------------


def words_of(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def importance_by_hand(rows, target, percent=25, least=20, buckets=10_000):
    def cells(text):
        w = words_of(text)
        return [crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(cells(text))
    for text in target:
        t.update(cells(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        c = cells(text)
        weight = sum(map(gain, c)) // len(c) if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = len(drawn) * percent // 100
    ranks = defaultdict(list)
    for place, r in enumerate(drawn):
        ranks[r].append(place + 1 if place < k else None)
    return Counter((*r[:4], ranks[r].pop(0) if r[4] else None) for r in out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = ["Ab", "é", "Zürich", "x1", "of", "the"] + [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, "\x00 -- \n"), (4, "one"), (None, " ".join(rng.choice(words, 30)))]
    rows += [(10 + i, "-".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 80, 90))]
    rows += [rows[30]] * 3 + [(7, " ".join(words[:25])), (7, " ".join(words[:40])), (500, " ".join(rng.choice(words, 20_000)))]
    return rows, ["of the w1 w2 w3", None, "", "W1 é zürich of"]


def test_importance_equals_brute_force(spark, texts):
    rows, target = texts
    docs = crowded(frame(spark, [(i, t, "en") for i, t in rows]))
    goal = crowded(spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert Counter(map(tuple, importance.report(docs, goal).collect())) == importance_by_hand(rows, target)


def test_slices_do_not_change_features(texts):
    texts = pa.array([t for _, t in texts[0]])
    whole = importance.features(texts, 10_000)
    parts = [importance.features(texts.slice(a, b - a), 10_000) for a, b in importance.slices(texts, 300)]
    assert len(parts) > 5
    assert all((np.concatenate([p[i] for p in parts]) == whole[i]).all() for i in range(3))


def test_draw_returns_the_rows_as_they_are(spark, texts):
    rows, target = texts
    docs = crowded(frame(spark, [(i, t, "en") for i, t in rows]))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = importance.draw(docs, goal)
    want = sum(n for r, n in importance_by_hand(rows, target).items() if r[4] is not None)
    assert drawn.columns == docs.columns and drawn.count() == want
    assert drawn.exceptAll(docs).count() == 0


def test_many_equal_rows_get_distinct_ranks(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(30)), "en")] * 400 + [(2, "short", "en")]
    found = importance.report(frame(spark, rows), spark.createDataFrame([("w1 w2",)], "text string")).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 101)) and len(found) == 401


def test_importance_of_nothing(spark):
    empty, no_goal = frame(spark, []), spark.createDataFrame([], "text string")
    assert importance.report(empty, no_goal).count() == 0
    assert [tuple(r)[:3] for r in importance.report(frame(spark, [(1, "a b", "en")]), no_goal).collect()] == [(1, 3, importance_by_hand([(1, "a b")], []).popitem()[0][2])]


# -- decontamination ------------------------------------------------------------------


def leaks_by_hand(rows, items, n):
    windows = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[s : s + m])].add(i)
    out = []
    for i, text in rows:
        w, hit, ids = words_of(text), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    ids |= windows[tuple(w[s : s + m])] - {None}
        names = sorted(str(x) for x in ids)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def leaks():
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(50)] + ["Été", "naïve"]
    make = lambda n: " ".join(rng.choice(words, n))
    items = [(i, make(int(n))) for i, n in enumerate(rng.integers(8, 40, 25))]
    items += [(100, "Rare Word, pair"), (101, None), (102, ""), (103, "--"), (None, make(12)), (104, items[0][1]), (0, items[3][1]), (11, "alone")]
    rows = [(1, None), (2, ""), (3, "...\n"), (4, "RARE word-pair and  more"), (5, items[0][1].translate({v: k for k, v in LOWER.items()})), (6, "Alone.")]
    for i in range(60):
        text = make(int(rng.integers(1, 60)))
        if i % 3 == 0:
            body = items[i % 25][1].split()
            text += "; " + " ,".join(body[max(len(body) // 4 - 1, 0) :]) + "! " + make(5)
        rows.append((10 + i, text))
    rows += [rows[8], rows[8], (None, "a " + items[2][1]), (10, "again " + items[4][1]), (900, make(10_000) + " " + items[28][1] + " " + make(10_000))]
    return rows, items


def leak_tables(spark, leaks):
    rows, items = leaks
    return crowded(frame(spark, [(i, t, "en") for i, t in rows])), crowded(spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("few", [True, False])
def test_hits_equal_brute_force(spark, leaks, n, few, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1_000_000 if few else 0)
    docs, items = leak_tables(spark, leaks)
    found = decontaminate.report(docs, items, n).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, found)) == leaks_by_hand(*leaks, n)


def test_a_full_bitmap_changes_nothing(spark, leaks, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    docs, items = leak_tables(spark, leaks)
    found = decontaminate.report(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, found)) == leaks_by_hand(*leaks, 10)


def test_removal(spark, leaks):
    docs, items = leak_tables(spark, leaks)
    hit = {k[0] for k in leaks_by_hand(*leaks, 10) if k[5]}
    kept = decontaminate.decontaminate(docs, items, remove="documents")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in leaks[0] if not leaks_by_hand([(i, t)], leaks[1], 10).popitem()[0][5])
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert texts[5] == "" and texts[6] == "" and texts[1] is None and texts[3] == "...\n"
    assert texts[4] == "and  more"
    assert {i: texts[i] for i, t in leaks[0] if i not in hit} == {i: t for i, t in leaks[0] if i not in hit}
    again = decontaminate.report(cut, items)
    assert again.where("contaminated").count() <= 1  # what is left may meet anew


def test_removal_keeps_what_stands_around(spark):
    docs = frame(spark, [(1, "(start) one, TWO three! four  five", "en"), (2, "two three", "en"), (3, "one two", "en")])
    items = spark.createDataFrame([(1, "two-three")], "item_id long, text string")
    found = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert found == {1: "(start) one, four  five", 2: "", 3: "one two"}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame(spark, []), none).count() == 0
    found = decontaminate.report(frame(spark, [(1, "a b", "en")]), none).first()
    assert (found.n_words, found.n_hit, found.n_items, found.contaminated) == (2, 0, 0, False)
    assert decontaminate.decontaminate(frame(spark, [(1, "a b", "en")]), none).first().text == "a b"
