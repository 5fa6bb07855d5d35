"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into ``distance + 1`` blocks; two that differ in at most
``distance`` bits share a block.  Distinct fingerprints meet by block value, and
each meeting is verified by Hamming distance.  A crowded block value is divided
by the same rule over the remaining bits, which loses no link, so work follows
the number of fingerprints and not the square of a group.  Of the links in a
block value, a spanning forest is passed on; components come from alternating
large-star and small-star rounds over these links, each written to the shared
checkpoint folder.

Texts of fewer words than a shingle hash as a whole; null, empty and blank texts
have fingerprint zero, which links like any other.  Repeated rows stay rows; a
null id is never a component id unless the component has no other.  An empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, saved, two_columns

BITS = 64
#: A block value with more fingerprints than this is divided before it is dealt to tasks.
CROWD = 2_000_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    if len(own) <= words:
        return xxh64_intdigest(b" ".join(own), seed)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate([[0], ends[: -words]]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
    n = len(hashes)
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, n, 4096):  # in parts, which bounds the unpacked bits
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` for each row of docs; fp: the fingerprint as a signed long."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

        return run

    picked = two_columns(docs, id_col, text_col)
    return picked.mapInArrow(by_slice(make), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def cuts(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Bits low .. high - 1 in so many runs of about equal length."""
    at = [low + (high - low) * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a - b: (member, smallest member)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def links(fps: np.ndarray, distance: int, bits: list[int] | None = None, small: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of the distinct fingerprints (uint64) within
    the distance connect, at most one for each fingerprint.  bits: where they may
    differ still; None: nothing is known of them."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    free = list(range(BITS)) if bits is None else bits
    if len(fps) <= small or len(free) < 2 * (distance + 1):
        return _compared(fps, distance)
    a, b = [], []
    for low, high in cuts(0, len(free), distance + 1):
        own, rest = free[low:high], free[:low] + free[high:]
        mask = np.uint64(sum(1 << k for k in own))
        order = np.argsort(fps & mask, kind="stable")
        sorted_fps = fps[order]
        edge = np.flatnonzero(np.diff(sorted_fps & mask)) + 1
        bounds = np.concatenate([[0], edge, [len(fps)]])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s > 1:
                p, q = links(sorted_fps[s:e], distance, rest, small) if e - s < len(fps) else _compared(sorted_fps[s:e], distance)
                a.append(p)
                b.append(q)
    if not a:
        return fps[:0], fps[:0]
    return _forest(np.concatenate(a), np.concatenate(b))


def _compared(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints against all, a block of rows at a time."""
    a, b = fps[:0], fps[:0]
    step = max(1, (1 << 20) // len(fps))
    for s in range(0, len(fps), step):
        near = np.bitwise_count(fps[s : s + step, None] ^ fps[None, s:]) <= distance
        i, j = np.nonzero(near)
        more = j > i
        if more.any():
            a, b = _forest(np.concatenate([a, fps[s:][i[more]]]), np.concatenate([b, fps[s:][j[more]]]))
    return a, b


def _links_in_runs(distance: int):
    """For rows sorted by block value: links within each value."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def out(parts: list[np.ndarray], block: int):
            free = [k for low, high in cuts(0, BITS, distance + 1)[:block] + cuts(0, BITS, distance + 1)[block + 1 :] for k in range(low, high)]
            return links(np.unique(np.concatenate(parts)), distance, free)

        for batch in batches:
            blocks, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fps):
                continue
            edge = np.flatnonzero((np.diff(values) != 0) | (np.diff(blocks) != 0)) + 1
            bounds = [0, *edge.tolist(), len(fps)]
            a, b = [], []
            sizes = np.diff(bounds)
            for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = (int(blocks[s]), int(values[s]))
                if own != key:
                    if sum(map(len, held)) > 1:
                        p, q = out(held, key[0])
                        a.append(p)
                        b.append(q)
                    key, held = own, []
                if k < len(sizes) - 1 and not held and sizes[k] == 1:
                    continue
                held.append(fps[s:e])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], schema=schema)
        if sum(map(len, held)) > 1:
            a, b = out(held, key[0])
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return run


def near_links(nodes: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect
    all within the distance."""
    runs = cuts(0, BITS, distance + 1)
    value = lambda low, high: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), value(*r).alias("value")) for k, r in enumerate(runs)))
    dealt = nodes.select("fp", F.explode(blocks).alias("s")).select(F.col("s.block").alias("block"), F.col("s.value").alias("value"), "fp")
    crowded = dealt.groupBy("block", "value").count().filter(F.col("count") > crowd).select("block", "value").collect()
    if crowded:  # at most (distance + 1) x nodes / crowd of them
        hot = dealt.sparkSession.createDataFrame(crowded, "block int, value long").withColumn("hot", F.lit(True))
        marked = dealt.join(F.broadcast(hot), ["block", "value"], "left")
        finer = None
        for k, (low, high) in enumerate(runs):
            rest = [x for x in range(BITS) if not low <= x < high]
            parts = [rest[p:q] for p, q in cuts(0, len(rest), distance + 1)]
            sub = [sum((F.shiftrightunsigned("fp", x).bitwiseAND(F.lit(1)) * (1 << i) for i, x in enumerate(p)), F.lit(0)) for p in parts]
            here = marked.filter(F.col("hot") & (F.col("block") == k)).select("block", "value", "fp", F.explode(F.array(*(s + ((j + 1) << 32) for j, s in enumerate(sub)))).alias("sub"))
            finer = here if finer is None else finer.unionByName(here)
        dealt = marked.filter("hot is null").select("block", F.col("value").alias("value"), "fp").unionByName(finer.select("block", F.xxhash64("value", "sub").alias("value"), "fp"))
    sorted_rows = dealt.repartition("block", "value").sortWithinPartitions("block", "value").select(F.col("block").cast("int"), F.col("value").cast("long"), "fp")
    return sorted_rows.mapInArrow(_links_in_runs(distance), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, low`` of each node of the links a - b: the smallest node it reaches.
    Rounds go on until a round changes nothing; their number grows with the logarithm
    of the links."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(low, "u")
        if large:
            return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    downward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = saved(downward), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 31) - 1))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        now = saved(star(star(now, True), False))
    low = now.groupBy("a").agg(F.min("b").alias("low"))
    return low.select(F.col("a").alias("node"), "low")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of docs; component_id: the smallest
    id that links reach."""
    rows = saved(fingerprints(docs, id_col, text_col, words, seed))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    low = components(near_links(nodes.select("fp"), distance))
    placed = nodes.join(low.withColumnRenamed("node", "fp"), "fp", "left").withColumn("low", F.coalesce("low", "fp"))
    ids = placed.groupBy("low").agg(F.min("first_id").alias("component_id"))
    classes = placed.select("fp", "low").join(ids, "low").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def simhash_classes(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, fingerprint, component_id``; fingerprint: 16 hexadecimal digits."""
    found = simhash_components(docs, **kw)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
