"""Ranked lexical search over a clustered index, with exact stopping.

Terms are what ``TERM`` matches after lower-casing A-Z.  Documents are put in the order
of a recursive graph bisection: the tree comes from ``SAMPLE`` documents, drawn row by
row, and every document goes down it; in a leaf, the order is that of ids.  The index is
this order cut into shards of at most ``SHARD`` documents, each with the impacts of the
items' terms and, for every item, a bound: the sum of its terms' highest impacts in the
shard.  An item first visits the shards with its ``first`` highest bounds; its k-th score
there is the mark, and it then visits every other shard whose bound reaches the mark,
equal ones included, and none below.  So the result is exact.  Scores are integers, and
of equal ones the smaller id comes first, whatever the order of the index.

Items are taken in blocks of bounded bytes and number; one block's terms, weights and
marks are broadcast, and each block is a scan of the documents.  Document frequencies,
the number of documents and their length cover all documents.

A null text has no terms; an item without terms has no rows, and so has one whose terms
no document holds.  Repeated rows are documents, or items, of their own; a null id comes
last among equal scores.  Either table may be empty.  Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .bisection import Tree, buckets
from .common import SLICE_BYTES, by_slice, two_columns, written

#: A term, after lower-casing: digits, small letters and whatever isn't ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
SAMPLE, SHARD = 4096, 512
#: Items and bytes of their texts in a block.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 8 << 20


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often each term is in the text, and how many terms it has."""
    data, counts, n, start = (text or "").encode().lower(), Counter(), 0, 0  # bytes: A-Z only
    while start < len(data):
        cut = _BETWEEN.search(data, min(len(data), start + SLICE_BYTES))
        end = cut.start() if cut else len(data)
        found = TERM.findall(data, start, end)
        counts.update(found)
        n += len(found)
        start = end + 1
    return counts, n


class Block:
    """Some items and their terms.  mult: how often an item has a term."""

    def __init__(self, items: list[Row]):
        self.ids = [r.doc_id for r in items]
        self.terms: dict[bytes, int] = {}
        item, term, mult = [], [], []
        for k, r in enumerate(items):
            for t, m in term_counts(r.text)[0].items():
                item.append(k)
                term.append(self.terms.setdefault(t, len(self.terms)))
                mult.append(m)
        order = np.argsort(np.array(term, np.int64), kind="stable")
        self.item, self.mult = np.array(item, np.int64)[order], np.array(mult, np.int64)[order]
        self.at = np.searchsorted(np.array(term, np.int64)[order], np.arange(len(self.terms) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, n_docs: int, frequencies: dict[int, int]) -> None:
        for t in range(len(self.terms)):
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(t, 0) + 1)))

    def scores(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, wanted: np.ndarray) -> np.ndarray:
        """Of postings in the order of terms: the wanted items' scores of each document."""
        place = np.full(len(self.ids), -1)
        place[wanted] = np.arange(len(wanted))
        out = np.zeros((n_docs, len(wanted)), np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(terms)) + 1, [len(terms)]]) if len(terms) else np.zeros(1, int)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            t = int(terms[s])
            own = slice(self.at[t], self.at[t + 1])
            to = place[self.item[own]]
            here = to >= 0
            if here.any():
                out[docs[s:e, None], to[here]] += impacts[s:e, None] * (self.weights[t] * self.mult[own][here])
        return out

    def bounds(self, terms: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """The highest score that the items can have, from that of each term's impact."""
        peak = np.zeros(len(self.terms), np.int64)
        peak[terms] = highest
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.item, np.repeat(peak * self.weights, np.diff(self.at)) * self.mult)
        return out


def _blocks(items: DataFrame) -> Iterator[Block]:
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and (len(held) == BLOCK_ITEMS or size + len(r.text or "") > BLOCK_BYTES):
            yield Block(held)
            held, size = [], 0
        held.append(r)
        size += len(r.text or "")
    if held:
        yield Block(held)


def fit_order(docs: DataFrame, sample: int = SAMPLE, depth: int = 6, seed: int = 17) -> Tree:
    """The bisections of a sample of ``doc_id, text``, ``sample`` rows at most."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch({"buckets": pa.array([buckets(term_counts(t)[0]) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))})

        return run

    n = docs.count()
    drawn = docs.sample(fraction=min(1.0, 1.1 * sample / n), seed=seed).limit(sample) if n > sample else docs
    found = drawn.mapInArrow(by_slice(make), "buckets array<int>").collect()  # sample x BUCKETS numbers at most
    return Tree([np.array(r.buckets, np.int32) for r in found], depth)


def _postings(terms, tree):
    """For rows ``doc_id, text``: the leaf, the number of terms, and how often each of the
    wanted terms is there."""

    def make():
        known, order = terms.value, tree.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, counts, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                own, n = term_counts(text)
                both = [(known[t], c) for t, c in own.items() if t in known]
                sizes.append(n)
                ids.append([t for t, _ in both])
                counts.append([c for _, c in both])
                lists.append(buckets(own))
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            leaves = order.leaves(np.concatenate(lists), at)
            return pa.record_batch(
                {"doc_id": batch.column(0), "leaf": pa.array(leaves, pa.int32()), "n": pa.array(sizes, pa.int64()), "terms": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64()))}
            )

        return run

    return make


def _shards(block, n_docs: int, length: int, id_type: pa.DataType, size: int):
    """For documents in order: shards of up to ``size`` of them, none over two leaves."""
    schema = pa.schema([("leaf", pa.int32()), ("ids", pa.list_(id_type)), ("docs", pa.binary()), ("terms", pa.binary()), ("impacts", pa.binary()), ("bounds", pa.list_(pa.int64()))])

    def shard(part: pa.Table) -> pa.RecordBatch:
        own = block.value
        lists = part.column("terms").combine_chunks()
        docs = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        terms, counts = lists.flatten().to_numpy(), part.column("counts").combine_chunks().flatten().to_numpy()
        m = np.array([75 + 25 * n * n_docs // length for n in part.column("n").to_pylist()], np.int64)
        impacts = 1_000_000_000 * counts // (1000 * counts + 12 * m[docs])
        order = np.argsort(terms, kind="stable")
        docs, terms, impacts = docs[order], terms[order], impacts[order]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        bounds = own.bounds(terms[first], np.maximum.reduceat(impacts, first) if len(first) else impacts)
        packed = [x.astype(kind).tobytes() for x, kind in ((docs, np.int32), (terms, np.int32), (impacts, np.int32))]
        return pa.record_batch([part.column("leaf")[:1].combine_chunks(), pa.array([part.column("doc_id").to_pylist()], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in packed), pa.array([bounds], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        held, n = [], 0  # of one leaf
        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
            for s, e in zip(edges, edges[1:], strict=False):
                if held and s < e and held[0].column("leaf")[0].as_py() != leaves[s]:
                    yield shard(pa.Table.from_batches(held))
                    held, n = [], 0
                while s < e:
                    k = min(e - s, size - n)
                    held.append(batch.slice(s, k))
                    s, n = s + k, n + k
                    if n == size:
                        yield shard(pa.Table.from_batches(held))
                        held, n = [], 0
        if held:
            yield shard(pa.Table.from_batches(held))

    return run


def _visits(block, low, high, least, id_type: pa.DataType, k: int):
    """For shards: the k best documents there of each item whose bound is ``low`` or more
    and under ``high``, and that score ``least`` or more."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", id_type), ("score", pa.int64())])

    def run(batches):
        own = block.value
        for batch in batches:
            items, found, scores = [], [], []
            for i in range(batch.num_rows):
                bounds = batch.column("bounds")[i].values.to_numpy()
                wanted = np.flatnonzero((bounds >= low) & (bounds < high))
                if not len(wanted):
                    continue
                docs, terms, impacts = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in ("docs", "terms", "impacts"))
                ids = batch.column("ids")[i].values
                table = own.scores(docs, terms, impacts, len(ids), wanted)
                for j, item in enumerate(wanted.tolist()):
                    near = np.flatnonzero(table[:, j] >= max(1, least[item]))
                    near = near[np.argsort(-table[near, j], kind="stable")[:k]]  # ids are in order
                    items.append(np.full(len(near), item, np.int32))
                    found.append(ids.take(pa.array(near)))
                    scores.append(table[near, j])
            if items:
                yield pa.record_batch([pa.array(np.concatenate(items)), pa.concat_arrays(found), pa.array(np.concatenate(scores))], schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, first: int = 4, shard: int = SHARD) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item.  Its jobs run
    while the result is being built."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    picked = two_columns(docs, id_col, text_col)
    queries = two_columns(items, item_col, item_text_col)
    kind, item_kind = (x.schema["doc_id"].dataType.simpleString() for x in (picked, queries))
    id_type = to_arrow_type(picked.schema["doc_id"].dataType)
    share = spark.sparkContext.broadcast
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    tree = None
    for block in _blocks(queries):
        if not block.terms:
            continue
        tree = tree or share(fit_order(picked))
        index = written(picked.mapInArrow(by_slice(_postings(share(block.terms), tree)), f"doc_id {kind}, leaf int, n long, terms array<int>, counts array<long>"))
        n_docs, length = index.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # of the block's terms
        block.weigh(n_docs, {r.t: r.df for r in frequencies})
        sent = share(block)
        ordered = index.filter(F.size("terms") > 0).repartitionByRange("leaf", F.asc_nulls_last("doc_id")).sortWithinPartitions("leaf", F.asc_nulls_last("doc_id"))
        shards = written(ordered.mapInArrow(_shards(sent, n_docs, length, id_type, shard), f"leaf int, ids array<{kind}>, docs binary, terms binary, impacts binary, bounds array<long>"))
        n = len(block.ids)
        bounds = shards.select(F.posexplode("bounds").alias("item", "score")).withColumn("doc_id", F.lit(0)).filter("score > 0")
        highest = {r.item: r.cut for r in _best(bounds, first).groupBy("item").agg(F.min("score").alias("cut")).collect()}  # a row an item
        cut = np.array([highest.get(i, 1) for i in range(n)])
        visit = lambda low, high, least: shards.mapInArrow(_visits(sent, low, high, least, id_type, k), f"item int, doc_id {kind}, score long")  # noqa: B023, E731
        top = written(visit(cut, np.full(n, np.iinfo(np.int64).max), np.ones(n, np.int64)))
        marks = {r.item: r.mark for r in _best(top, k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("mark")).filter(F.col("n") == k).collect()}
        mark = np.array([marks.get(i, 1) for i in range(n)])
        rest = visit(np.minimum(mark, cut), cut, mark)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {item_kind}")
        ranked = _best(top.unionByName(rest), k).join(F.broadcast(names), "item")
        out = out.unionByName(written(ranked.select("item_id", "rank", "doc_id", "score")))
    return out
