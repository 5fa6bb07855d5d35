"""Ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from windrose.llm import ranked_search as module
from windrose.llm.bisection import Tree, buckets
from windrose.llm.ranked_search import ranked_search, term_counts

from .conftest import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return [w.translate(LOW) for w in TERM.findall(t or "")]


def by_hand(rows, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def cases(seed, n=300):
    random.seed(seed)
    topics = [[f"t{a}w{k}" for k in range(30)] for a in range(6)]
    common = ["the", "of", "É", "and9", "x"]
    rows = []
    for i in range(n):
        own = random.choice(topics)
        rows.append((random.randrange(2 * n), " ".join(random.choice(common if random.random() < 0.3 else own).upper() if random.random() < 0.2 else random.choice(own + common) for _ in range(random.randint(0, 60)))))
    rows += [(2000 + k, rows[3][1]) for k in range(60)]  # ties beyond the k best
    items = [(k, ", ".join(random.choices(random.choice(topics) + common, k=random.choice([1, 3, 12, 40])))) for k in range(25)]
    return rows + ODD, items + [(25, None), (26, "..."), (27, "nowhere"), (27, items[0][1]), (None, items[1][1]), (28, "the the the")]


def found(spark, docs, rows, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_search(docs(rows).repartition(5), bench, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize(("seed", "kw"), [(1, {"shard": 7, "first": 1}), (2, {"shard": 16}), (3, {}), (1, {"k": 3, "shard": 5, "first": 2})])
def test_search(spark, docs, seed, kw):
    rows, items = cases(seed)
    assert found(spark, docs, rows, items, **kw) == by_hand(rows, items, kw.get("k", 20))


def test_items_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ITEMS", 7)
    rows, items = cases(4, 80)
    assert found(spark, docs, rows, items) == by_hand(rows, items)


def test_sampled_order_changes_nothing(spark, docs):
    rows, items = cases(5)
    picked = docs(rows).select("doc_id", "text")
    assert len(module.fit_order(picked, sample=50).costs) == 63
    assert found(spark, docs, rows, items) == by_hand(rows, items)


def test_empty_and_clashing(spark, docs, empty, clashing):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(empty, bench).count() == 0
    assert ranked_search(docs([(1, "a")]), bench.limit(0)).count() == 0
    assert ranked_search(docs([(1, None), (2, "")]), bench).count() == 0
    got = ranked_search(clashing([(2, "a"), (1, "A"), (3, "c")]), bench).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(module, "SLICE_BYTES", 50)
    random.seed(6)
    text = "".join(random.choices("aB9é漢 .,\n", k=5000)) + "x" * 300
    counts, n = term_counts(text)
    assert {t.decode(): c for t, c in counts.items()} == Counter(terms(text)) and n == len(terms(text))


def test_bisection_parts_topics():
    """Documents on two topics in a mixed order: a leaf's share one."""
    random.seed(7)
    topics = [[f"{a}{k}".encode() for k in range(200)] for a in "ab"]
    made = [(k % 2, buckets(random.sample(topics[k % 2], 60))) for part in (range(200), range(200, 400)) for k in random.sample(part, 200)]
    tree = Tree([d for _, d in made[:200]], depth=3)
    at = np.concatenate([[0], np.cumsum([len(d) for _, d in made])])
    leaves = tree.leaves(np.concatenate([d for _, d in made]), at)
    sides = {topic: {leaf // 4 for leaf, (t, _) in zip(leaves.tolist(), made, strict=True) if t == topic} for topic in (0, 1)}
    assert len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    assert len(set(leaves.tolist())) == 8
