"""The audit of filters against every order applied in turn."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from windrose.llm.filter_audit import failure_masks, filter_audit

from .conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(rows):
    """For each (doc_id, text, lang): the letters of its failing filters."""
    out = []
    for i, t, _ in rows:
        text = t or ""
        w = WORD.findall(text)
        own = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(own + "E" * any(i is not None and j is not None and j < i and (u or "") == text for j, u, _ in rows))
    return out


def by_hand(rows, labels):
    own = list(zip(rows, fails(rows), strict=True))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out, share = {}, {}
    for part in sorted({r[2] or "" for r in rows}):
        here = [(r[0], f) for r, f in own if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in here if x in d[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(d[1] == x for d in here), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))
                share[part, x] = share.get((part, x), 0) + len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def cases(seed):
    random.seed(seed)
    texts = [None, "", "A", "Some # text", "same " * 120, " ".join(f"w{k}" for k in range(150)), " ".join(f"W{k}" for k in range(150)), " ".join(f"w{k}|" for k in range(150)), "É " * 99 + "x y"]
    texts += [" ".join(f"w{random.randrange(n)}" for _ in range(random.randint(80, 140))) for n in (60, 300, 1000) for _ in range(6)]
    rows = [(random.choice([None, *range(60)]), random.choice(texts), random.choice(["en", "fr", "", None])) for _ in range(150)]
    rows += [(100 + k, texts[4], "en") for k in range(150)]  # more copies than a partition has rows
    rows += [(i, t, "en") for i, t in ODD]
    labels = [(random.choice([None, *range(300)]), random.choice([None, 0, 1]), random.choice([None, 0, 1])) for _ in range(200)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", ["1", "23"])
def test_audit(spark, seed, partitions):
    rows, labels = cases(seed)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masks = sorted(((r.doc_id, "".join(x for k, x in enumerate("ABCDE") if r.mask >> k & 1)) for r in failure_masks(docs.repartition(7)).collect()), key=repr)
        assert masks == sorted(((r[0], f) for r, f in zip(rows, fails(rows), strict=True)), key=repr)
        assert found(filter_audit(docs.repartition(5), known)) == by_hand(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches(spark):
    """Groups of copies that go on over many batches and tasks."""
    rows = [(k, f"text {k // 40}", None) for k in range(200)] + [(7, "text 0", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = failure_masks(docs).filter("mask < 16").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.doc_id for r in got) == [0, 40, 80, 120, 160]


def test_empty_and_clashing(spark, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, labels).count() == 0
    got = filter_audit(clashing([(2, "x"), (1, "x")]), labels.limit(0), part_col="run").filter("filter_order = 'EABCD' AND step = 1").first()
    assert (got.part, got.kept, got.removed, got.good_lost) == ("3", 1, 1, 0)
