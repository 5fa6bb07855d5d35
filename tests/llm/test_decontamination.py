"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from windrose.llm.decontamination import contamination, find_contamination, without_contaminated, without_spans

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def by_hand(rows, items, n=13):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            own = words(text)
            k = min(n, len(own))
            grams = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if own else set()
            at = [j for j in range(len(w) - k + 1) if own and tuple(w[j : j + k]) in grams]
            if at:
                found.add(str(item))
            for j in at:
                hit |= set(range(j, j + k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases(seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "é", "ß2", "Z9"]
    items = [(k, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 2, 3, 5, 12, 13, 14, 40])))) for k in range(25)]
    items += [(25, None), (26, items[-1][1]), (27, "Same, WORDS: here twice")]
    rows = []
    for i in range(60):
        parts = random.choices(vocabulary, k=random.randint(0, 30))
        if random.random() < 0.6:
            own = words(random.choice(items)[1])
            a = random.randrange(len(own) + 1)
            parts += own[a : a + random.randint(0, 30)] + random.choices([f"u{k}" for k in range(40)], k=random.randint(0, 80))
        rows.append((i, random.choice([" ", ", ", "\n- "]).join(parts).upper() if i % 3 else " ".join(parts)))
    return rows + ODD, items


COLUMNS = "doc_id n_words n_hit n_items items_sha256 contaminated".split()


@pytest.mark.parametrize(("seed", "max_set"), [(1, 20_000), (2, 20_000), (1, 25)])
def test_contamination(spark, docs, seed, max_set):
    rows, items = cases(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs(rows), bench, max_set=max_set).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == by_hand(rows, items)


def test_a_large_benchmark_goes_in_parts(spark, docs, monkeypatch):
    """200,000 entries in several scans: what brute force finds, and no entry on the driver."""
    random.seed(12)
    items = [(k, " ".join(f"v{random.randrange(60_000)}" for _ in range(200))) for k in range(10_500)]
    by_id = dict(items)
    rows = []
    for i in range(40):
        own, a = words(by_id[i * 250]), i * 3
        rows.append((i, " ".join(["free"] * 30 + own[a : a + 10 + i] + ["free"] * 40)))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    collected = []
    kind = type(bench)
    monkeypatch.setattr(kind, "collect", lambda df, f=kind.collect: collected.append(f(df)) or collected[-1])
    found = contamination(docs(rows), bench, max_set=50_000, max_windows=1000)
    assert collected and max(map(len, collected)) <= 13  # sizes of windows; no entry of the set
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in found.collect()}
    want = {i: (80 + i, 10 + i if i >= 3 else 0, int(i >= 3)) for i in range(40)}
    assert got == want


def test_long_items_only(spark, docs):
    random.seed(4)
    items = [(k, " ".join(random.choices([f"w{j}" for j in range(50)], k=30))) for k in range(5)]
    rows = [(i, " ".join(["x"] * i + words(items[i % 5][1])[i % 7 : i % 7 + 14] + ["y"] * 3 * i)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs(rows), bench).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == by_hand(rows, items)
    spans = find_contamination(docs(rows), bench).filter("doc_id = 0").first().spans
    assert [tuple(s) for s in spans] == [(0, 13), (1, 13)]


def test_empty_tables_and_clashes(spark, docs, odd, empty, clashing):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(empty, bench).count() == 0
    assert {r.n_hit for r in contamination(odd, none).collect()} == {0} and contamination(odd, none).count() == len(ODD)
    assert {r.doc_id: r.n_hit for r in contamination(clashing([(1, "x a b"), (2, "b a")]), bench).collect()} == {1: 2, 2: 0}


def test_filter_keeps_columns_and_clean_rows(spark, odd):
    bench = spark.createDataFrame([("q", "same words here")], "item_id string, text string")
    out = without_contaminated(odd, bench)
    assert out.columns == odd.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, (i for i, _ in ODD if i != 4)))


def test_spans_are_cut(spark, docs, odd):
    bench = spark.createDataFrame([(1, "b c d"), (2, "d e")], "item_id long, text string")
    rows = [(1, "A: b, C d!"), (2, ". b c d. e"), (3, "c d b"), (4, None), (5, "x B c D - E; f")]
    got = {r.doc_id: r.text for r in without_spans(docs(rows), bench).collect()}
    assert got == {1: "A: !", 2: ". ", 3: "c d b", 4: None, 5: "x ; f"}
    assert without_spans(odd, bench).exceptAll(odd).count() == 0
