"""How quality filters interact: what each removes in every order, by part.

Five filters fail a text: A, fewer than ``min_words`` words; B, too few distinct words;
C, too many capitals; D, any of ``marks``; E, a text that a row with a smaller id has,
removed or not.  Words are runs of what isn't a blank, in their case.

E is found by sorting: rows are dealt by ranges of (SHA-256 of the text, id), so that a
group of copies of any size spreads over tasks, and sorted by fingerprint, full text and
id.  Each row is held against its predecessor.  What begins a task may go on from the
task before: there, a row that isn't yet a copy is left open, each task names the group
that it ends with and its first id, and open rows (one a task, and its repetitions) meet
these by fingerprint.  What fails is a mask of five bits; masks are added up by part, 32
counters at most, from which all orders and steps follow.

A null text is empty, a null part is the empty string.  Of repeated rows with the same
id none is the other's copy; a null id is neither smaller than another nor a copy.  Labels
of ids that no row has don't count; of several labels of an id, one that says 1 is enough.
An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written

FILTERS = "ABCDE"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _own_failures(text: Column, words: Column, min_words: int, min_distinct: int, max_capitals: int, marks: str) -> Column:
    """The mask of A to D, which need one text only."""
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, string.ascii_uppercase, ""))
    fails = {
        "A": n < min_words, "B": 100 * F.size(F.array_distinct(words)) < min_distinct * n,
        "C": 100 * capitals.cast("long") > max_capitals * F.char_length(text).cast("long"), "D": F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m)),
    }
    return sum((c.cast("int") * _bit(k) for k, c in fails.items()), F.lit(0))


def _against_predecessor(id_type: pa.DataType):
    """For sorted rows ``doc_id, part, mask, fp, text``: their masks with E, the fingerprint
    of those that the task before may decide, and last the group that ends here."""
    schema = pa.schema([("ends", pa.bool_()), ("doc_id", id_type), ("part", pa.string()), ("mask", pa.int32()), ("fp", pa.binary())])

    def run(batches):
        text = fp = first = None  # of the row before: its text and fingerprint, and the first id of its group
        begun = False  # whether a second text has begun, so that no task before can matter
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, texts, fps = batch.column("doc_id"), batch.column("text"), batch.column("fp")
            same = np.zeros(n, bool)
            same[0] = text is not None and texts[0].as_py() == text
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(same, -1, np.arange(n)))  # of each row's group; -1: it began before
            heads = ids.take(pa.array(np.maximum(start, 0)))
            if start[0] < 0:
                heads = pc.if_else(pa.array(start < 0), pa.scalar(first, id_type), heads)
            copies = pc.fill_null(pc.less(heads, ids), False).to_numpy(zero_copy_only=False)
            open_ = np.zeros(n, bool)
            if not begun:
                new = np.flatnonzero(~same)
                new = new[new > 0] if text is None else new
                end = int(new[0]) if len(new) else n
                open_[:end] = ~copies[:end]
                begun = bool(len(new))
            masks = batch.column("mask").to_numpy(zero_copy_only=False) + copies.astype(np.int32) * _bit("E")
            yield pa.record_batch([pa.array(np.zeros(n, bool)), ids, batch.column("part"), pa.array(masks.astype(np.int32)), pc.if_else(pa.array(open_), fps, pa.scalar(None, pa.binary()))], schema=schema)
            text, fp, first = texts[n - 1].as_py(), fps[n - 1].as_py(), heads[n - 1].as_py()
        if text is not None:
            yield pa.record_batch([pa.array([True]), pa.array([first], id_type), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([fp], pa.binary())], schema=schema)

    return run


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, marks: str = "#$%&*|") -> DataFrame:
    """``doc_id, part, mask`` for each row of docs; a bit of mask for each failing filter,
    A the lowest."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("fp"))
    order = F.asc_nulls_last("doc_id")
    dealt = rows.repartitionByRange("fp", order).sortWithinPartitions("fp", "text", order)
    split = dealt.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = split.select("doc_id", "part", _own_failures(F.col("text"), F.col("words"), min_words, min_distinct, max_capitals, marks).alias("mask"), "fp", "text")
    id_type = rows.schema["doc_id"].dataType
    found = written(own.mapInArrow(_against_predecessor(to_arrow_type(id_type)), f"ends boolean, doc_id {id_type.simpleString()}, part string, mask int, fp binary"))
    ends = found.filter("ends").groupBy("fp").agg(F.min("doc_id").alias("least"))  # a row a task at most
    met = found.filter("NOT ends").join(F.broadcast(ends), "fp", "left")
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).cast("int") * _bit("E")
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: how many rows of a part fail just these filters, and
    how many of those are labelled of good quality and toxic."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    met = counted.join(known, "doc_id", "left")
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def interactions(counters: DataFrame) -> DataFrame:
    """Of additive counters, for each part, order of the filters and step: what the step's
    filter removes there, what it finds removed already, and what it alone removes."""
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))  # 32 at most
    orders = ",".join("".join(p) for p in itertools.permutations(FILTERS))
    steps = parts.select("part", "counters", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1)"
    steps = steps.withColumns({
        "own": F.expr(bit.replace(" i,", " step,")),
        "before": F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (a, i) -> a + if(i < step, {bit}, 0))"),
    })
    fails, gone = (lambda c: c["mask"].bitwiseAND(F.col("own")) > 0), (lambda c: c["mask"].bitwiseAND(F.col("before")) > 0)

    def total(when, value=lambda c: c["n"]) -> Column:
        return F.aggregate("counters", F.lit(0).cast("long"), lambda a, c: a + F.when(when(c), value(c)).otherwise(F.lit(0).cast("long")))

    # of the orders, a filter comes first of the k that fail in one of k
    share = lambda c: c["n"] * F.element_at(F.array(*(F.lit(math.factorial(len(FILTERS)) // k) for k in range(1, len(FILTERS) + 1))), F.bit_count(c["mask"]).cast("int"))
    here = lambda c: fails(c) & ~gone(c)
    return steps.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"), total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``: 600 rows a part."""
    return interactions(part_counters(failure_masks(docs, id_col, **kw), labels))
