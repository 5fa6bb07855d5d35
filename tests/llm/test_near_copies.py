"""The pipeline's near copies against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrose.llm import near_copies as nc

from .conftest import ODD


def similarity(a, b):
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) or {tuple(t.lower().split())} for t in (a or "", b or ""))
    return len(x & y) / len(x | y)


def kept_by_hand(rows, linked=lambda a, b: similarity(a, b) >= 0.8):
    """Ids that stay, from all pairs; ids are distinct."""
    low = {i: i for i, _ in rows}
    find = lambda i: i if low[i] == i else find(low[i])
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if linked(a, b):
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    return {i for i, _ in rows if find(i) == i}


def edited(words, n):
    out = list(words)
    for at in random.sample(range(0, len(words), 5), n):
        out[at] = f"new{random.random()}"
    return out


def test_stage_finds_copies_from_a_similarity_of_08(spark, docs, tmp_path):
    """Pairs on both sides of 0.8, most of them close to it, and sets of unlike sizes."""
    random.seed(5)
    rows, near = [], 0
    for i in range(150):
        base = [f"w{random.randrange(3000)}" for _ in range(200)]
        other = base[: 155 + i // 5] if i % 5 == 0 else edited(base, i % 4 if i % 5 == 1 else 3 + i % 4)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        near += similarity(rows[-1][1], rows[-2][1]) >= 0.8
    close = [similarity(rows[k][1], rows[k + 1][1]) for k in range(0, 300, 2)]
    assert sum(0.75 < s < 0.8 for s in close) > 20 and sum(0.8 <= s < 0.85 for s in close) > 20
    want = kept_by_hand(rows)
    docs(rows).repartition(5).write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path)).collect()}
    assert got == want and len(rows) - len(want) == near


def within(distance):
    fps = {}

    def linked(a, b):
        x, y = (fps[t] if t in fps else fps.setdefault(t, int.from_bytes(nc.fingerprint(nc.shingles(t)), "little")) for t in (a, b))
        return (x ^ y).bit_count() <= distance

    return linked


@pytest.mark.parametrize("crowd", [2, 5, 4096])
def test_crowds_lose_no_link(docs, crowd):
    """Chains, whose ends aren't alike themselves, one group of copies of copies, and
    copies of a base that are alike only through it or not at all, divided into tiles
    or not."""
    random.seed(9)
    rows = []
    for _ in range(4):
        words = [f"w{random.randrange(3000)}" for _ in range(160)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = edited(words, 2)
    for n, base in ((3, [f"v{k}" for k in range(200)]), (6, [f"u{k}" for k in range(200)])):
        rows += [(len(rows) + k, " ".join(edited(base, n))) for k in range(25)] + [(900 + n, " ".join(base))]
    rows += [(1000 + k, "one two three four five six seven") for k in range(80)]
    keyed = docs(rows).select(F.struct(F.lit(False).alias("no_id"), F.col("doc_id").alias("id"), F.struct(F.lit(0), "doc_id").alias("row")).alias("key"), "text")
    got = {r.key.id for r in nc.near_copies(keyed, crowd=crowd).collect() if r.key == r.kept}
    assert got == kept_by_hand(rows)
    assert 903 not in got and 906 in got


def test_the_distance_stands_for_the_similarity():
    random.seed(3)
    for n, least, most in ((1, 0.9, 1), (3, 0.8, 0.9), (12, 0.4, 0.7)):
        for _ in range(20):
            base = [f"w{random.randrange(9000)}" for _ in range(200)]
            a, b = " ".join(base), " ".join(edited(base, n))
            assert least <= similarity(a, b) <= most
            assert within(nc.distance_at(0.8, 1))(a, b) == (n < 5)
            assert n < 12 or not within(nc.sure_distance(0.8))(a, b)
            assert n > 3 or set(nc.blocks(nc.shingles(a)).tolist()) & set(nc.blocks(nc.shingles(b)).tolist())


def test_long_texts_go_in_parts():
    words = [f"w{k}" for k in range(12_000)]
    s = nc.shingles(" ".join(words))
    bits = np.unpackbits(np.frombuffer(nc.fingerprint(s), np.uint8))
    assert len(bits) == nc.BITS and 400 < bits.sum() < 624 and len(set(nc.blocks(s).tolist())) == nc.BLOCKS
    assert len(nc.blocks(s[:0])) == 0 and set(nc.blocks(s[:3]).tolist()) != set(nc.blocks(s[1:4]).tolist())


def test_odd_rows(odd, empty, clashing):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in nc.one_of_each(odd).collect())
    assert nc.one_of_each(empty).count() == 0
    assert [g[:2] for g in got if g[2].strip() == ""] == [(False, 1)]
    assert len(got) == len({" ".join(t.lower().split()) for _, t in ODD if t and t.strip()}) + 1
    df = clashing([(2, "x"), (1, "x")])
    assert nc.one_of_each(df).columns == df.columns and nc.one_of_each(df).first().doc_id == 1


def test_rows_stay_apart_whatever_their_order(spark, docs, tmp_path):
    """Of repeated rows exactly one stays, from files and from a table dealt anew."""
    df = docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (None, "q r s t u v"), (None, None)] * 3)
    df.repartition(4).write.parquet(f"{tmp_path}/docs")
    for table in (df.repartition(7), spark.read.parquet(f"{tmp_path}/docs")):
        assert sorted((r.doc_id or 0, r.text or "") for r in nc.one_of_each(table).collect()) == [(0, ""), (1, "a b c d e f"), (2, "q r s t u v")]
