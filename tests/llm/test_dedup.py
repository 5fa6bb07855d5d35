"""Exact, substring, line and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from windrose.llm import simhash
from windrose.llm.exact_dedup import exact_dedup
from windrose.llm.line_dedup import line_dedup, line_dedup_digests
from windrose.llm.substring_dedup import from_bits, from_gaps, bits, gaps, substring_dedup

from .conftest import ODD

BLANK = re.compile("[\x20\x09-\x0d]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def words(t):
    return [w for w in BLANK.split(t or "") if w]


# ── exact ──


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((i, t or ""))
    out = []
    for bare, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, keep[0], len(own), sha(bare)) for i, _ in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact(docs, fan_in):
    random.seed(fan_in)
    rows = [(i, random.choice(["a b", "ab", "a  b ", "c", None, "", "\t"])) for i in range(60)] + ODD
    got = exact_dedup(docs(rows).repartition(7), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_by_hand(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}


def test_exact_empty_and_clashing(empty, clashing):
    assert exact_dedup(empty).count() == 0
    assert exact_dedup(clashing([(2, "x"), (1, "x")])).filter("kept").first().doc_id == 1


# ── substrings ──


def substrings_by_hand(rows, n):
    count = Counter(tuple(w[k : k + n]) for w in map(words, (t for _, t in rows)) for k in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3, 35])
def test_substrings(docs, n):
    random.seed(n)
    shared = [" ".join(random.choices("abcdefgh", k=40)) for _ in range(3)]
    rows = [(i, " ".join(random.choices("abcdefghijklmnopqrst", k=random.randint(0, 30)) + random.choices(shared, k=random.randint(0, 2)) + ["é x"])) for i in range(40)] + ODD
    got = substring_dedup(docs(rows).repartition(5), n=n, spare=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == substrings_by_hand(rows, n)
    assert all(sha(r.kept) == r.kept_sha256 for r in got)


def test_substrings_in_many_slices_ranges_and_buckets(docs):
    random.seed(8)
    shared = [" ".join(random.choices("abcdefgh", k=12)) for _ in range(5)]
    rows = [(i, " ".join(random.choices("abcdefghijklmnopqrst", k=random.randint(0, 40)) + random.choices(shared, k=random.randint(0, 3)))) for i in range(150)] + ODD
    got = substring_dedup(docs(rows).repartition(3), n=6, spare=1, slice_bytes=500, range_bits=7, bucket=20).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == substrings_by_hand(rows, 6)


@pytest.mark.parametrize("power", [10, 11, 12])
def test_words_of_a_weak_polynomial_stay_apart(docs, power):
    """Thue-Morse words, which polynomials modulo 2^64 confuse, and such orders of words."""
    flags = [bin(k).count("1") % 2 for k in range(1 << power)]
    a, b = ("".join("ab"[f ^ x] for f in flags) for x in (0, 1))
    rest = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest]))]
    assert {r.n_removed for r in substring_dedup(docs(rows)).collect()} == {0}
    rows = [(i, " ".join(("x", "y")[f ^ i] for f in flags)) for i in (0, 1)]
    got = substring_dedup(docs(rows), n=len(flags)).collect()
    assert {r.n_removed for r in got} == {0}


def test_substrings_empty_and_clashing(empty, clashing):
    assert substring_dedup(empty).count() == 0
    assert {r.n_removed for r in substring_dedup(clashing([(1, "a b"), (2, "a b c")]), n=2).collect()} == {2}


def test_sketch_parts_come_back():
    random.seed(1)
    values = np.array(sorted(random.sample(range(1 << 25), 300)))
    for own in (values, values[:0], np.arange(300), np.array([0, 1 << 61])):
        assert (from_gaps(gaps(own)) == own).all()
    flags = values % 3 == 0
    assert (from_bits(bits(flags), len(flags)) == flags).all()


# ── lines ──


def lines_by_hand(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out.append((i, len(lines), len(gone), sha("\n".join(x for k, x in enumerate(lines) if k not in gone))))
    return sorted(out, key=repr)


def test_lines(docs):
    random.seed(3)
    rows = [(i, "\n".join(random.choices(["a", "b", "", "same"], k=random.randint(1, 12)))) for i in range(40)] + ODD + [(50, "q\n" * 50)]
    rows = [r for r in rows if r[0] != 4 or r is ODD[3]]  # equal ids have no order among them
    got = line_dedup_digests(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got), key=repr) == lines_by_hand(rows)


def test_lines_keep_columns_and_nulls(odd, empty, clashing):
    out = line_dedup(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert out.filter("doc_id = 1").first().text is None
    assert line_dedup(empty).count() == 0
    assert line_dedup(clashing([(1, "a\nb\nc"), (2, "a\nb\nc")])).filter("doc_id = 2").first().text == ""


# ── near ──


def fingerprint_by_hand(t, k=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(rows, distance=3):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, f"{fps[k]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def near_rows(seed, n=120):
    random.seed(seed)
    base = [random.choices([f"w{k}" for k in range(500)], k=400) for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 30])):
            w[random.randrange(len(w))] = f"z{random.randrange(99)}"
        rows.append((1000 - i, " ".join(w)))
    return rows + ODD


@pytest.mark.parametrize("seed", [1, 2])
def test_near(docs, seed):
    rows = near_rows(seed)
    got = simhash.simhash_classes(docs(rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == classes_by_hand(rows)


def test_classes_of_empty_and_clashing_tables(empty, clashing):
    assert simhash.simhash_classes(empty).count() == 0
    assert {r.component_id for r in simhash.simhash_classes(clashing([(2, "x"), (1, "x")])).collect()} == {1}


def linked(fps, a, b):
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y) is not None
        parent[find(x)] = find(y)
    return {int(f): min(int(g) for g in fps if find(int(g)) == find(int(f))) for f in fps}


@pytest.mark.parametrize("small", [2, 512])
def test_links_of_a_crowd(small):
    """Dense balls and chains, divided or not: the same components as all pairs give."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    pairs = [(x, y) for i, x in enumerate(fps.tolist()) for y in fps.tolist()[:i] if (x ^ y).bit_count() <= 3]
    want = linked(fps, *(np.array(c, np.uint64) for c in zip(*pairs, strict=True)))
    a, b = simhash.links(fps, 3, small=small)
    assert len(a) < len(fps)
    assert linked(fps, a, b) == want


def test_crowded_blocks_are_divided_without_loss(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 50)}
    for x in list(fps):
        fps |= {x ^ 1 << int(k) ^ 1 << int(j) for k, j in rng.integers(0, 62, (4, 2))}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    few = {(r.node, r.low) for r in simhash.components(simhash.near_links(nodes, crowd=3)).collect()}
    assert few == {(r.node, r.low) for r in simhash.components(simhash.near_links(nodes)).collect()} and few


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.low for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
