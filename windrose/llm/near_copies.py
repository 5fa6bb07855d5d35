"""SimHash near copies from a similarity of 0.8 on, by pigeonhole blocks of samples.

A fingerprint of 64 bits can't tell a similarity of 0.8: a pair there differs in some
ten bits, so that blocks that it surely shares are five bits wide and hold everything.
So a text has a wide fingerprint, the SimHash of its distinct five-word shingles in
``BITS`` bits, and beside it ``BLOCKS`` blocks, each the SimHash of a small sample: the
``SAMPLE`` shingles with the least hashes by the block's key.  Two texts share a block
where the samples agree, at a similarity of 0.8 with a chance of 0.33, so one of the
blocks with a chance of 0.9999.  Texts join on blocks, and a meeting counts where the
Hamming distance of the wide fingerprints is that of the angle with the cosine
2s / (1 + s), s the similarity, or up to ``LOOSE`` deviations more.

That distance is an estimate, so it only gathers candidates: texts that such meetings
connect are a class, and within a class texts are linked where their sets of shingles
are as similar as asked, exactly.  A class's texts meet once more for that, each once.

Texts with the same set of shingles are one node.  A block value, or a class, with more
than ``crowd`` nodes is never one task: its nodes are held against its smallest one first
(in a class by a distance that leaves no doubt); those that this leaves apart (none, in
a group of copies) meet all others in tiles of ``crowd`` by ``crowd``, which loses no
link.  Components come from the links.

Texts of fewer words than a shingle hash as a whole; null, empty and blank texts are
one group.  Repeated rows stay rows until one of their group is chosen, a null id
comes last.  An empty table gives no rows; other columns are kept and not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, numbered, ship, written
from .simhash import components

BITS, BLOCKS, SAMPLE = 1024, 24, 5
#: Deviations by which candidates may exceed the distance, and by which no doubt is left.
LOOSE, SURE = 4.0, 5.0
#: Rows up to which the nodes of classes are broadcast to their texts.
_FEW = 200_000
#: Shingles expanded at a time; at most 255, so that bits are counted in bytes.
_PART = 255
_RNG = np.random.default_rng(42)
_KEYS = _RNG.integers(0, 1 << 63, (2, BLOCKS), np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = _RNG.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of 64-bit hashes: bits that are set in over half of them."""
    rows, n = hashes.shape
    set_bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(rows, n, 8), axis=2, bitorder="little").sum(axis=1)
    return np.packbits(2 * set_bits > n, axis=1, bitorder="little").view(np.uint64).ravel()


def blocks(hashes: np.ndarray) -> np.ndarray:
    """The block values of a set; none for an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.zeros((BLOCKS, 0), np.uint64)
    for k in range(0, len(hashes), 4096):  # in parts, which bounds the product
        keyed = (hashes[None, k : k + 4096] ^ _KEYS[0][:, None]) * _KEYS[1][:, None]
        keyed ^= keyed >> np.uint64(32)
        least = np.concatenate([least, keyed], axis=1)
        if least.shape[1] > SAMPLE:
            least = np.partition(least, SAMPLE - 1, axis=1)[:, :SAMPLE]
    value = _majority(least * np.uint64(0x9E3779B97F4A7C15) ^ least >> np.uint64(29))
    return (value ^ np.arange(BLOCKS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The wide SimHash of a set of hashes."""
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _PART):
        wide = (hashes[k : k + _PART, None] ^ _WIDE) * _WIDE[::-1]
        wide ^= wide >> np.uint64(31)
        wide *= np.uint64(0x7FB5D329728EA185)
        wide ^= wide >> np.uint64(27)
        set_bits += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes()


def _distance(cosine: float, sigmas: float) -> int:
    p = math.acos(cosine) / math.pi
    return int(BITS * p + sigmas * math.sqrt(BITS * p * (1 - p)))


def distance_at(similarity: float, sigmas: float = LOOSE) -> int:
    """Differing bits up to which texts may be that similar."""
    return _distance(2 * similarity / (1 + similarity), sigmas)


def sure_distance(similarity: float) -> int:
    """Differing bits up to which texts are that similar, whatever their sizes: a set
    and a part of it have the smallest angle."""
    return max(0, _distance(math.sqrt(similarity), -SURE))


def _sketches(keyed: DataFrame, words: int) -> DataFrame:
    """``key, node, blocks, fp`` for each row of ``key, text``; node: a digest of the set."""

    def make():
        from xxhash import xxh128_digest

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            return pa.record_batch(
                {
                    "key": batch.column(0), "node": pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "blocks": pa.array([blocks(s) for s in sets], pa.list_(pa.int64())), "fp": pa.array([fingerprint(s) for s in sets], pa.binary()),
                }
            )

        return run

    return keyed.mapInArrow(by_slice(make), f"key {keyed.schema['key'].dataType.simpleString()}, node binary, blocks array<long>, fp binary")


def _bits_apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links between rows of fps that connect all within the distance: each row is held
    against those that no link has reached yet."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            q = queue.pop()
            near = _bits_apart(fps[q], fps[left]) <= distance
            if near.any():
                found = left[near].tolist()
                a += [q] * len(found)
                b += found
                queue += found
                left = left[~near]
    return a, b


def _across(fps: np.ndarray, settled: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of rows that aren't settled to settled ones, which are one group: at most
    one for each."""
    a, b, group = [], [], np.flatnonzero(settled)
    for k in np.flatnonzero(~settled).tolist():
        near = _bits_apart(fps[k], fps[group]) <= distance
        if near.any():
            a.append(k)
            b.append(int(group[near.argmax()]))
    return a, b


def _linked(distance: int):
    """For rows ``value, i, j, settled, node, fp`` sorted by the first three: links
    within each tile."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        held: list[tuple] = []  # of the tile that may go on: keys, settled, nodes, fps

        def links(settled, nodes, fps):
            a, b = _across(fps, settled, distance) if settled.any() else forest(fps, distance)
            return [nodes[k] for k in a], [nodes[k] for k in b]

        def last():
            if sum(len(h[1]) for h in held) > 1:
                return links(np.concatenate([h[1] for h in held]), sum((h[2] for h in held), []), np.concatenate([h[3] for h in held]))
            return [], []

        def out(a, b):
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            settled = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            nodes = batch.column(4).to_pylist()
            fps = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]])
            a, b = [], []
            pairs = bounds[1:-1][np.diff(bounds)[1:] == 2]
            pairs = pairs[(pairs > 0) & (pairs + 2 < len(keys))]  # tiles of two rows, wholly in this batch
            pairs = pairs[_bits_apart(fps[pairs], fps[pairs + 1]) <= distance]
            a += [nodes[k] for k in pairs.tolist()]
            b += [nodes[k + 1] for k in pairs.tolist()]
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                inside = s > 0 and e < len(keys)
                if inside:
                    if e - s > 2:
                        p, q = links(settled[s:e], nodes[s:e], fps[s:e])
                        a += p
                        b += q
                    continue
                if held and (held[0][0] != keys[s]).any():
                    p, q = last()
                    a += p
                    b += q
                    held.clear()
                held.append((keys[s], settled[s:e], nodes[s:e], fps[s:e]))
            yield out(a, b)
        yield out(*last())

    return run


def _tiled(many: DataFrame, crowd: int, *carried: str) -> DataFrame:
    """The nodes of crowded values (``value, node, settled`` and the carried columns) in
    tiles ``i, j``: those that aren't settled meet each other and the settled ones, which
    don't meet each other."""
    size = many.groupBy("value").agg(F.count_if("settled").alias("c"), F.count_if(~F.col("settled")).alias("r")).filter("r > 0")
    parts = lambda n: F.ceil(F.col(n) / crowd).cast("int")
    open_ = many.join(size.select("value", parts("c").alias("c"), parts("r").alias("r")), "value")
    own = F.pmod(F.xxhash64("node", "value"), F.when(F.col("settled"), F.col("c")).otherwise(F.col("r"))).cast("int")
    open_ = open_.withColumn("own", own)
    up_to = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    inner = open_.filter("NOT settled").select("value", "node", *carried, F.lit(False).alias("settled"), "own", F.explode(up_to(F.col("r"))).alias("k"))
    inner = inner.select("value", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "settled", "node", *carried)
    others = open_.select("value", "node", *carried, "settled", "own", "r", F.explode(up_to(F.when(F.col("settled"), F.col("r")).otherwise(F.col("c")))).alias("k"))
    others = others.select("value", F.when(F.col("settled"), F.col("k")).otherwise(F.col("own")).alias("i"), (F.col("r") + F.when(F.col("settled"), F.col("own")).otherwise(F.col("k"))).alias("j"), "settled", "node", *carried)
    return inner.unionByName(others)


def similar_links(nodes: DataFrame, distance: int, crowd: int = 4096) -> DataFrame:
    """``a, b``: links between nodes (``node, blocks, fp``) that share a block value and
    are within the distance, enough to connect all such."""
    dealt = nodes.select("node", F.explode("blocks").alias("value"))
    shared = written(dealt.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1"))
    fps = nodes.select("node", "fp")
    members = dealt.join(shared, "value").join(fps, "node")
    zero = F.lit(0)
    few = members.filter(F.col("n") <= crowd).select("value", zero.alias("i"), zero.alias("j"), F.lit(False).alias("settled"), "node", "fp")
    tiles, links = few, None
    hot = shared.filter(F.col("n") > crowd)
    if hot.limit(1).count():
        pivots = hot.select("value", "pivot").join(fps.select(F.col("node").alias("pivot"), F.col("fp").alias("pivot_fp")), "pivot")
        many = written(dealt.join(pivots, "value").join(fps, "node").mapInArrow(_to_pivots(distance), "value long, node binary, fp binary, settled boolean, pivot binary"))
        links = many.filter("settled AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        tiles = few.unionByName(_tiled(many, crowd, "fp"))
    sorted_rows = tiles.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").select("value", "i", "j", "settled", "node", "fp")
    found = sorted_rows.mapInArrow(_linked(distance), "a binary, b binary")
    return (found if links is None else found.unionByName(links)).distinct()


class _Sets:
    """Sets of shingles, and which of them are as similar as asked to one of them."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes, self.similarity = np.array([len(s) for s in sets]), similarity
        kinds, self.kind = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.kind, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]  # by kind
        self.by_kind = np.concatenate([[0], np.cumsum(np.bincount(self.kind, minlength=len(kinds)))])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    def near(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are."""
        own = self.kind[self.at[k] : self.at[k + 1]]
        starts, lengths = self.by_kind[own], self.by_kind[own + 1] - self.by_kind[own]
        steps = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owner[steps], minlength=len(self.sizes))[others]
        return common * (1 + self.similarity) >= self.similarity * (self.sizes[k] + self.sizes[others]) - 1e-9

    def links(self, settled: np.ndarray) -> tuple[list[int], list[int]]:
        """Links that connect all that are similar; settled ones are one group."""
        a, b, group = [], [], np.flatnonzero(settled)
        if len(group):
            for k in np.flatnonzero(~settled).tolist():
                near = self.near(k, group)
                if near.any():
                    a.append(k)
                    b.append(int(group[near.argmax()]))
            return a, b
        left = np.arange(len(self.sizes))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                q = queue.pop()
                near = self.near(q, left)
                found = left[near].tolist()
                a += [q] * len(found)
                b += found
                queue += found
                left = left[~near]
        return a, b


def _with_sets(words: int):
    """For rows ``value, i, j, settled, node, text``: the set for the text; texts of other
    nodes, where keys repeat, fall out."""

    def make():
        from xxhash import xxh128_digest

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            own = [xxh128_digest(s) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
            names = ["value", "i", "j", "settled", "node"]
            return pa.record_batch([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "set"]).filter(pa.array(own))

        return run

    return by_slice(make)


def _verified(similarity: float):
    """For rows sorted by value and tile: links by the sets themselves."""

    def run(batches):
        held, key = [], None

        def out():
            if len(held) < 2:
                return pa.record_batch([pa.array([], pa.binary())] * 2, names=["a", "b"])
            own = _Sets([np.frombuffer(s, np.uint64) for _, _, s in held], similarity)
            a, b = own.links(np.array([x for x, _, _ in held]))
            return pa.record_batch([pa.array([held[k][1] for k in a], pa.binary()), pa.array([held[k][1] for k in b], pa.binary())], names=["a", "b"])

        for batch in batches:
            for value, i, j, settled, node, own in zip(*(batch.column(c).to_pylist() for c in ("value", "i", "j", "settled", "node", "set")), strict=True):
                if (value, i, j) != key:
                    yield out()
                    held, key = [], (value, i, j)
                held.append((settled, node, own))
        yield out()

    return run


def exact_links(keyed: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, similarity: float, crowd: int = 4096) -> DataFrame:
    """``a, b``: links that connect the nodes (``node, first, fp``; first: a key of it)
    whose sets are as similar as asked, of those that the candidate links connect."""
    low = written(components(candidates).select("node", "low"))
    size = low.groupBy("low").agg((F.count("*") + 1).alias("n"))
    placed = low.unionByName(low.select(F.col("low").alias("node"), "low").distinct()).join(size, "low").join(nodes.select("node", "first", "fp"), "node")
    members = written(placed.select(F.xxhash64("low").alias("value"), F.col("low").alias("pivot"), "node", "first", "fp", "n"))
    zero = F.lit(0)
    tiles = members.filter(F.col("n") <= crowd).select("value", zero.alias("i"), zero.alias("j"), F.lit(False).alias("settled"), "node", "first")
    links = None
    hot = members.filter(F.col("n") > crowd)
    if hot.limit(1).count():
        pivots = hot.filter("node = pivot").select("value", F.col("fp").alias("pivot_fp"))
        many = written(hot.join(pivots, "value").mapInArrow(_to_pivots(sure_distance(similarity)), "value long, node binary, fp binary, settled boolean, pivot binary"))
        links = many.filter("settled AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        tiles = tiles.unionByName(_tiled(many, crowd).join(members.select("node", "first"), "node").select(*tiles.columns))
    tiles = written(tiles)
    if tiles.count() <= _FEW:
        tiles = F.broadcast(tiles)
    met = keyed.join(tiles, F.col("key") == F.col("first")).select("value", "i", "j", "settled", "node", "text")
    sets = met.mapInArrow(_with_sets(words), "value long, i int, j int, settled boolean, node binary, set binary")
    found = sets.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(_verified(similarity), "a binary, b binary")
    return found if links is None else found.unionByName(links)


def _to_pivots(distance: int):
    """For rows ``node, value, pivot, pivot_fp, fp``: whether each is within the distance
    of its pivot."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("fp", "pivot_fp"))
                near = pa.array(_bits_apart(own, pivot) <= distance)
                yield pa.record_batch([batch.column("value"), batch.column("node"), batch.column("fp"), near, batch.column("pivot")], names=["value", "node", "fp", "settled", "pivot"])

    return run


def near_copies(keyed: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 4096) -> DataFrame:
    """``key, kept`` for each row of ``key, text``; kept: the smallest key that links reach."""
    ship(keyed.sparkSession)
    rows = written(_sketches(keyed, words))
    nodes = written(rows.groupBy("node").agg(F.min("key").alias("first"), F.first("blocks").alias("blocks"), F.first("fp").alias("fp")))
    candidates = similar_links(nodes, distance_at(similarity), crowd)
    low = components(exact_links(keyed, nodes, candidates, words, similarity, crowd))
    placed = nodes.select("node", "first").join(low, "node", "left").withColumn("low", F.coalesce("low", "node"))
    kept = placed.groupBy("low").agg(F.min("first").alias("kept"))
    classes = placed.join(kept, "low").select("node", "kept")
    return rows.select("key", "node").join(classes, "node").select("key", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, **kw) -> DataFrame:
    """The rows of docs, with their columns, that stay: of each group the one with
    the smallest id, then the earliest row; a null id comes last."""
    name = "__near_row"
    rows = numbered(docs, name)
    keyed = rows.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(name).alias("row")).alias("key"), F.col(text_col).alias("text"))
    found = near_copies(keyed, words, similarity, **kw)
    # written, so that its size is known: a small one is broadcast and texts stay where they are
    gone = written(found.filter(F.col("key") != F.col("kept")).select(F.col("key.row").alias(name)))
    return rows.join(gone, name, "left_anti").select(*docs.columns)
