"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from windrose.llm.embedding_dedup import code_size, codes, embedding_dedup, passed

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, least=0.98):
    """``vec_id, n_links, component_id, kept`` of (vec_id, vector, label)."""

    def unit(v, label):
        if v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v, label) for _, v, label in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, n[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=repr)


def cloud(rng, n, spread, dim=24):
    """Vectors about one direction."""
    x = rng.standard_normal(dim)
    out = x / np.linalg.norm(x) + spread * rng.standard_normal((n, dim)) / math.sqrt(dim)
    return [v.astype(np.float32).tolist() for v in out]


def found(spark, rows, **kw):
    return sorted((tuple(r) for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()), key=repr)


@pytest.mark.parametrize("crowd", [4096, 20])
@pytest.mark.parametrize("spread", [0.03, 0.13, 0.2])
def test_all_pairs(spark, crowd, spread):
    """A dense cloud, copies, a chain, and unlike vectors; filters with a crowd too."""
    rng = np.random.default_rng(int(spread * 100))
    rows = [(k, v, k % 2) for k, v in enumerate(cloud(rng, 90, spread) + [v for _ in range(40) for v in cloud(rng, 1, 0.1)])]
    rows += [(200 + k, rows[5][1], 1) for k in range(30)] + [(300 + k, [2 * x for x in rows[7][1]], 1) for k in range(3)]
    a, b = np.eye(24)[:2]
    rows += [(400 + k, (math.cos(0.15 * k) * a + math.sin(0.15 * k) * b).astype(np.float32).tolist(), 1) for k in range(12)]
    assert found(spark, rows, crowd=crowd) == by_hand(rows)


def test_odd_vectors(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, v, 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [1.0, nan, 3.0], 1), (8, [1.0, inf, 3.0], 1), (9, [], 1),
        (10, [1.0, 2.0], 1), (11, [1.0, 2.0, 3.0001], 1), (11, [1.0, 2.0, 3.0001], 1), (None, v, 1), (None, [9.0, 0.0, 0.0], 3), (12, [-0.0, 2.0, 0.0], 4), (13, [0.0, 2.0, 0.0], 4), (14, [5.0], 5), (15, [2.0], 5), (16, [-2.0], 5), (17, [1e-38, 0.0], 6), (18, [3e38, 0.0], 6),
    ]
    got, want = found(spark, rows), by_hand(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_empty_and_clashing(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    names = "node vec values known dim filter home n i j side copies pivot filters".split()
    rows = [(k, [1.0, 0.5 * (k // 2)], 1, *range(len(names))) for k in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, " + ", ".join(f"{n} int" for n in names))
    assert [tuple(r) for r in embedding_dedup(table).orderBy("vec_id").collect()] == [(0, 1, 0, True), (1, 1, 0, False), (2, 1, 2, True), (3, 1, 2, False)]


@pytest.mark.parametrize("n", [100, 5000])
def test_decoding_finds_every_filter_above_the_threshold(n):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = codes(16, *code_size(n, 16.0), 16.0)[0]
    directions = np.zeros((1, 0))
    for own in code.own:
        directions = np.concatenate([np.repeat(directions, len(own), axis=0), np.tile(own, (len(directions), 1))], axis=1)
    inner = x @ code.rotation @ directions.T
    assert set(zip(*map(list, np.nonzero(inner > code.threshold)), strict=True)) == set(zip(*(c.tolist() for c in code.decode(x)), strict=True))
    assert (code.best(x) == inner.argmax(axis=1)).all()


def test_close_vectors_share_filters():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    own = codes(64, *code_size(5000, 16.0), 16.0)
    a, b = (set(zip(*(c.tolist() for c in passed(own, v)), strict=True)) for v in (x, y))
    assert len({k for k, _ in a & b}) >= 2998 and len(a) < 40 * len(x)
