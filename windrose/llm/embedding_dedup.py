"""Near-duplicate vectors by spherical-cap filters.

A random product code is a set of directions, one of each block's random unit vectors
put side by side, seen through a random rotation; its size is a power of that of a block.
A vector passes every filter whose direction it has an inner product above a threshold
with; these are found by list decoding, block by block, without looking at most of the
code.  Close vectors pass many filters together.  How many a vector passes varies much in
one code, since few combinations come near the threshold, so there are ``CODES`` codes
with rotations of their own, and of each a vector also passes its best filter: of 20,000
random pairs at a cosine of 0.98 every one shared a filter, and in codes for a million
vectors all but 4 of 10,000.  Vectors of a label join on filters, and what meets is
verified by its cosine in double precision.

For any vector, the expected number of filters is ``filters`` and somewhat more, whatever
the others are; codes grow with the number of vectors so that unlike ones seldom meet.  A
filter that one vector alone passes is dropped before vectors are sent.

Equal vectors are one node.  Of a pair that shares filters only the first counts the link,
so no pair is ever a row.  A filter with more than ``crowd`` nodes is never one task:
nodes within half the angle of the least node there are at home with it, and those with
one home are linked with each other by the triangle inequality and counted at once; the
rest meets itself and the filter's main home in tiles, which loses no pair.

A vector that is null, zero, or holds a null, NaN or infinite number, or has no label,
links with nothing; vectors of different lengths don't either.  Repeated ids are vectors
of their own; a null id is a component's id only if it has no other.  An empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .simhash import _forest, components

#: Filters above the threshold in the mean, of all codes; directions in a block at most.
FILTERS, CODES, LARGEST = 16, 12, 256
#: Rows of a tile that are compared at a time, and filters told apart at a time.
_ROWS, _KINDS = 512, 2048


class Code:
    """A random product code for vectors of ``dim`` numbers: ``parts`` blocks of ``size``."""

    def __init__(self, dim: int, parts: int, size: int, filters: float, seed: int):
        rng = np.random.default_rng([seed, dim, parts, size])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts, self.size = min(parts, dim), size
        cuts = [dim * k // self.parts for k in range(self.parts + 1)]
        self.blocks = list(zip(cuts, cuts[1:], strict=False))
        self.own = []
        for low, high in self.blocks:
            x = rng.standard_normal((size, high - low))
            self.own.append(x / np.linalg.norm(x, axis=1, keepdims=True) / math.sqrt(self.parts))
        tried = rng.standard_normal((512, dim))
        tried /= np.linalg.norm(tried, axis=1, keepdims=True)
        low, high = -1.0, 1.0  # of the threshold that random vectors exceed so many times
        guess = NormalDist().inv_cdf(1 - min(0.5, filters / size**self.parts)) / math.sqrt(dim)
        low, high = guess - 0.5 / math.sqrt(dim), min(1.0, guess + 1.5 / math.sqrt(dim))
        for _ in range(12):
            self.threshold = (low + high) / 2
            if len(self.decode(tried)[0]) > filters * len(tried):
                low = self.threshold
            else:
                high = self.threshold

    def _inner(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = vectors @ self.rotation
        return [turned[:, low:high] @ own.T for (low, high), own in zip(self.blocks, self.own, strict=True)]

    def best(self, vectors: np.ndarray) -> np.ndarray:
        """The filter with the highest inner product."""
        out = np.zeros(len(vectors), np.int64)
        for x in self._inner(vectors):
            out = out * self.size + x.argmax(axis=1)
        return out

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: which exceeds which filter's threshold, as (vector, filter)."""
        inner = self._inner(vectors)
        most = [x.max(axis=1) for x in inner]
        owner, filters, score = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for k, x in enumerate(inner):
            rest = sum(most[k + 1 :], np.zeros(len(vectors)))
            need = self.threshold - score - rest[owner]
            kept = [], [], []
            for s in range(0, len(owner), 1 << 14):  # in parts, which bounds the table
                part = owner[s : s + (1 << 14)]
                i, j = np.nonzero(x[part] > need[s : s + (1 << 14), None])
                kept[0].append(part[i])
                kept[1].append(filters[s : s + (1 << 14)][i] * self.size + j)
                kept[2].append(score[s : s + (1 << 14)][i] + x[part[i], j])
            owner, filters, score = (np.concatenate(c) if c else np.zeros(0) for c in kept)
            owner, filters = owner.astype(np.int64), filters.astype(np.int64)
        return owner, filters


@lru_cache(16)
def codes(dim: int, parts: int, size: int, filters: float) -> list[Code]:
    return [Code(dim, parts, size, filters / CODES, k) for k in range(CODES)]


def passed(own: list[Code], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which unit vectors pass which filters, as (vector, filter), each once."""
    owners, found = [], []
    for k, code in enumerate(own):
        owner, filters = code.decode(vectors)
        n = code.size**code.parts
        both = np.unique(np.concatenate([owner * n + filters, np.arange(len(vectors)) * n + code.best(vectors)]))
        owners.append(both // n)
        found.append(both % n + k * n)
    return np.concatenate(owners), np.concatenate(found)


def code_size(n: int, filters: float, largest: int = LARGEST) -> tuple[int, int]:
    """Blocks, and directions in each, for so many vectors: filters that unlike ones pass
    are their own in half the cases or more."""
    wanted = max(16.0, 2.0 * n * filters / CODES)
    parts = max(2, math.ceil(math.log(wanted) / math.log(largest)))
    return parts, max(2, math.ceil(wanted ** (1 / parts)))


def _unit(values) -> np.ndarray | None:
    """The vector at length 1, if it has a direction."""
    x = np.array(values, np.float64)  # null: NaN
    top = np.abs(x).max() if x.size else 0.0
    if not (np.isfinite(top) and top > 0):
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _units():
    """For rows ``vec_id, label, known, values``: the vector at length 1 as bytes, null if
    it has none or no label; node: a digest of label and vector."""

    def run(batches):
        for batch in batches:
            vectors, nodes = [], []
            for label, values in zip(batch.column("known").to_pylist(), batch.column("values").to_pylist(), strict=True):
                x = _unit(values) if label is not None and values is not None else None
                vectors.append(None if x is None else x.tobytes())
                nodes.append(None if x is None else hashlib.blake2b(x.tobytes() + label.encode(), digest_size=16).digest())
            yield pa.record_batch([batch.column("vec_id"), batch.column("known"), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "node", "vec"])

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _passed(parts: int, size: int, filters: float):
    """For rows ``label, dim, node, vec``: those of the filters that each node passes."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for s in range(0, own.num_rows, 1024):
                    part = own.slice(s, 1024)
                    owner, found = passed(codes(dim, parts, size, filters), _vectors(part.column("vec")))
                    at = pa.array(owner)
                    yield pa.record_batch([part.column("label").take(at), part.column("dim").take(at), pa.array(found), part.column("node").take(at)], names=["label", "dim", "filter", "node"])

    return run


def _cosines_to_pivot(least: float):
    """For rows ``node, vec, pivot, pivot_vec``: those whose cosine reaches ``least``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, pivots = batch.column("vec").to_pylist(), batch.column("pivot_vec").to_pylist()
                near = pa.array([float(np.frombuffer(a) @ np.frombuffer(b)) >= least for a, b in zip(own, pivots, strict=True)])
                yield pa.record_batch([batch.column("node"), batch.column("pivot")], names=["node", "home"]).filter(near)

    return run


class _Tile:
    """Nodes that pass a filter.  side: which of two sets a node is in, if two are held
    against each other; home: a number, below 0 for none."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        self.filter, self.across = table.column("filter")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        self.nodes, self.vecs = column("node"), _vectors(column("vec"))
        self.side, self.copies = column("side").to_numpy(), column("copies").to_numpy().astype(np.float64)
        homes = column("home").to_pylist()
        known = {h: k for k, h in enumerate(dict.fromkeys(h for h in homes if h is not None))}
        self.home = np.array([-1 if h is None else known[h] for h in homes])
        lists = column("filters")
        owner, values = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        earlier = values < self.filter
        kinds, self.kind, n = np.unique(values[earlier], return_inverse=True, return_counts=True)
        shared = n[self.kind] > 1
        self.owner, self.kind = owner[earlier][shared], self.kind[shared]
        self.n_kinds = len(kinds)

    def _passes(self, rows: np.ndarray, low: int) -> np.ndarray:
        """A table of these rows by the earlier filters from ``low`` on."""
        place = np.full(len(self.side), -1)
        place[rows] = np.arange(len(rows))
        mine = (place[self.owner] >= 0) & (self.kind >= low) & (self.kind < low + _KINDS)
        out = np.zeros((len(rows), min(_KINDS, self.n_kinds - low)), np.float32)
        out[place[self.owner[mine]], self.kind[mine] - low] = 1
        return out

    def compared(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node, the links that count here; and links that connect what is near."""
        n = len(self.side)
        counts = np.zeros(n)
        left, right = (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)) if self.across else (np.arange(n), np.arange(n))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(left), _ROWS):
            rows = left[s : s + _ROWS]
            cols = right if self.across else right[s:]
            near = self.vecs[rows] @ self.vecs[cols].T >= least
            if not self.across:
                near &= cols[None, :] > rows[:, None]
            near &= (self.home[rows, None] != self.home[None, cols]) | (self.home[rows, None] < 0)
            if not near.any():
                continue
            i, j = np.nonzero(near)
            a, b = _forest(np.concatenate([a, rows[i]]), np.concatenate([b, cols[j]]))
            for low in range(0, self.n_kinds, _KINDS):
                near &= ~(self._passes(rows, low) @ self._passes(cols, low).T > 0)
            counts[rows] += near @ self.copies[cols]
            counts[cols] += self.copies[rows] @ near
        return counts, a, b


def _tiles(least: float):
    """For rows sorted by filter and tile: ``node, n`` of the links that count there, and
    ``node, other`` of links that connect."""
    keys = ["label", "dim", "filter", "i", "j"]
    schema = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])

    def out(rows: list[pa.RecordBatch]):
        if sum(r.num_rows for r in rows) < 2:
            return
        tile = _Tile(rows)
        counts, a, b = tile.compared(least)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.record_batch([tile.nodes.take(pa.array(some)), pa.nulls(len(some), pa.binary()), pa.array(counts[some].astype(np.int64))], schema=schema)
            yield pa.record_batch([tile.nodes.take(pa.array(a)), tile.nodes.take(pa.array(b)), pa.nulls(len(a), pa.int64())], schema=schema)

    def run(batches):
        held, key = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for s, e in zip(starts, starts[1:], strict=False):
                if names[s] != key:
                    yield from out(held)
                    held, key = [], names[s]
                held.append(batch.slice(s, e - s))
        yield from out(held)

    return run


def _dealt(members: DataFrame, homes: DataFrame, crowd: int) -> DataFrame:
    """The members of crowded filters (``n`` nodes) in tiles: those that are at home with
    the filter's main home, C, aren't held against each other, the rest is."""
    met = members.join(homes, "node", "left")
    key = ["label", "dim", "filter"]
    main = met.filter("home IS NOT NULL").groupBy(*key, "home").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max_by("home", F.struct("c", "home")).alias("main"), F.max("c").alias("c"))
    parts = lambda n: F.ceil(n / crowd).cast("int")
    placed = met.join(main, key, "left").withColumn("settled", F.coalesce(F.col("home") == F.col("main"), F.lit(False))).withColumn("c", F.coalesce("c", F.lit(0)))
    placed = placed.withColumn("r", parts(F.col("n") - F.col("c"))).withColumn("c", parts(F.col("c"))).filter("r > 0")
    own = F.pmod(F.xxhash64("node", "filter"), F.when(F.col("settled"), F.col("c")).otherwise(F.col("r"))).cast("int")
    placed = placed.withColumn("own", own)
    up_to = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    tile = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    among = F.transform(up_to(F.col("r")), lambda k: tile(F.least("own", k), F.greatest("own", k), F.col("own") > k))
    to_main = F.transform(up_to(F.col("c")), lambda k: tile(F.col("own"), F.col("r") + k, F.lit(0)))
    to_rest = F.transform(up_to(F.col("r")), lambda k: tile(k, F.col("r") + F.col("own"), F.lit(1)))
    return placed.select(*key, "node", "home", F.explode(F.when(F.col("settled"), to_rest).otherwise(F.concat(among, to_main))).alias("t")).select(*key, "node", "home", "t.*")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = 0.98, filters: float = FILTERS, crowd: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row of vectors."""
    ship(vectors.sparkSession)
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("known"), F.col(vector_col).alias("values"))
    kind = picked.schema["vec_id"].dataType.simpleString()
    rows = written(picked.mapInArrow(_units(), f"vec_id {kind}, label string, node binary, vec binary"))
    each = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = written(each.withColumn("dim", F.expr("CAST(octet_length(vec) / 8 AS INT)")))
    most = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    size = code_size(most, filters)
    key = ["label", "dim", "filter"]
    met = written(nodes.select("label", "dim", "node", "vec").mapInArrow(_passed(*size, filters), "label string, dim int, filter long, node binary"))
    shared = met.groupBy(*key).agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    members = written(met.join(shared, key))
    slim = nodes.select("node", "vec", "copies")
    lists = members.groupBy("node").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    none = F.lit(None).cast("binary")
    zero = F.lit(0)
    tiles = members.filter(F.col("n") <= crowd).select(*key, "node", none.alias("home"), zero.alias("i"), zero.alias("j"), zero.alias("side"))
    hot, homes = members.filter(F.col("n") > crowd), None
    if not hot.isEmpty():
        half = math.cos(math.acos(similarity) / 2) + 1e-9
        pivots = hot.select("pivot").distinct().join(slim.select(F.col("node").alias("pivot"), F.col("vec").alias("pivot_vec")), "pivot")
        near = hot.select("node", "pivot").distinct().join(pivots, "pivot").join(slim.select("node", "vec"), "node")
        homes = written(near.mapInArrow(_cosines_to_pivot(half), "node binary, home binary").groupBy("node").agg(F.min("home").alias("home")))
        tiles = tiles.drop("home").join(homes, "node", "left").select(*tiles.columns).unionByName(_dealt(hot, homes, crowd))
    sent = tiles.join(slim, "node").join(lists, "node")
    sorted_rows = sent.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j").select(*key, "i", "j", "side", "node", "home", "vec", "copies", "filters")
    found = written(sorted_rows.mapInArrow(_tiles(similarity), "node binary, other binary, n long"))
    links = found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    counts = found.filter("n IS NOT NULL").select("node", "n")
    if homes is not None:
        at_home = homes.join(slim.select("node", "copies"), "node")
        total = at_home.groupBy("home").agg(F.sum("copies").alias("total"))
        counts = counts.unionByName(at_home.join(total, "home").select("node", (F.col("total") - F.col("copies")).alias("n")))
        links = links.unionByName(homes.filter("node <> home").select(F.col("node").alias("a"), F.col("home").alias("b")))
    low = components(links)
    placed = nodes.select("node", "first_id", "copies").join(low, "node", "left").withColumn("low", F.coalesce("low", "node"))
    ids = placed.groupBy("low").agg(F.min("first_id").alias("component_id"))
    degree = counts.groupBy("node").agg(F.sum("n").alias("n"))
    classes = placed.join(ids, "low").join(degree, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.filter("node IS NOT NULL").select("vec_id", "node").join(classes, "node").select("vec_id", "n_links", "component_id").unionByName(alone)


def embedding_dedup(vectors: DataFrame, **kw) -> DataFrame:
    """``vec_id, n_links, component_id, kept``; kept: the row's id is its component's."""
    found = embedding_components(vectors, **kw)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
