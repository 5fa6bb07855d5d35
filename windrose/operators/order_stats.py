"""Exact quantiles of groups of any size, by histograms of a fixed size.

A group's values are counted by sign and power of two; that bin of a wanted rank has
values within a factor of two of each other, and is counted again by ``BINS`` equal steps
between its least and its highest value, and again, until at most ``room`` values are left
in it or all are equal.  A double has 52 bits below its power of two and a pass settles
11, so whatever the values are, five such passes are the most.  Counts are merged as any
other aggregate; no buffer holds more than ``room`` values of a group, and all groups,
columns and ranks share the passes, over one written input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..sources.scratch import written

BINS = 2048
#: Spans of values up to which they are broadcast to the values.
_FEW = 100_000


def _power(x: Column) -> Column:
    """A number that doesn't fall as x grows: sign and power of two."""
    size = F.abs(x)
    finite = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))).cast("int") + 2000
    at = F.when(x == 0, 0).when(size == float("inf"), 4000).otherwise(finite)
    return F.when(x < 0, -at).otherwise(at)


def _placed(targets: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where the targets' ranks lie: keys and ``k`` of each target, with the bin's least and
    highest value, how many values are below it and in it.  counts: ``bin, n, lo, hi`` and
    ``below``, of all its bins, by keys."""
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    met = targets.join(steps, list(keys)).filter((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n")))
    return met.select("g", "c", "k", F.col("lo"), F.col("hi"), "below", "n")


def _with_spans(x: DataFrame, spans: DataFrame) -> DataFrame:
    """The values that lie in the spans of their group and column."""
    small = F.broadcast(spans) if spans.limit(_FEW + 1).count() <= _FEW else spans
    return x.join(small, ["g", "c"]).filter(F.col("x").between(F.col("lo"), F.col("hi")))


def quantile_table(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Sequence[float]], room: int = 100_000) -> DataFrame:
    """Keys and, for each column, an array of its exact quantiles with linear
    interpolation, for each group of df.  Null and NaN don't count (T1); a group without
    values has nulls, a null key is a group.

    df is written once.  Where no group has more than ``room`` values, they are sorted
    group by group.  These jobs run while the result is being built."""
    names = list(columns)
    g = F.struct(*map(F.col, keys)) if keys else F.struct(F.lit(0).alias("all"))
    values = F.array(*(F.struct(F.lit(i).alias("c"), known(F.col(c)).cast("double").alias("x")) for i, c in enumerate(names)))
    x = written(df.select(g.alias("g"), F.explode(values).alias("v")).select("g", "v.c", "v.x"))
    groups = x.groupBy("g", "c").agg(F.count("x").alias("n"))
    at = F.element_at(F.array(*(F.array(*(F.lit(float(p)) for p in columns[c])) for c in names)), F.col("c") + 1)
    if (groups.agg(F.max("n")).first()[0] or 0) <= room:
        found = x.groupBy("g", "c").agg(F.array_sort(F.collect_list("x")).alias("s"))
        value = lambda k: F.get("s", k)
        n = F.size("s")
    else:
        ranked = _ranks(x, groups, at, room)
        found = groups.join(ranked, ["g", "c"], "left")
        value = lambda k: F.col("values")[k.cast("long")]
        n = F.col("n")

    def between(p: Column) -> Column:
        rank = p * (n - 1)
        low = F.floor(rank).cast("int")
        return F.when(n > 0, F.when(rank == low, value(low)).otherwise((low + 1 - rank) * value(low) + (rank - low) * value(low + 1)))

    out = found.select("g", "c", F.transform(at, between).alias("q"))
    wide = out.groupBy("g").agg(*(F.first(F.when(F.col("c") == i, F.col("q")), ignorenulls=True).alias(f"q{i}") for i in range(len(names))))
    return wide.select(*(F.col("g")[k].alias(k) for k in keys), *(F.col(f"q{i}").alias(c) for i, c in enumerate(names)))


def _ranks(x: DataFrame, groups: DataFrame, at: Column, room: int) -> DataFrame:
    """``g, c, values``: a map from each rank, from 0, that the quantiles need to its value."""
    x = x.filter("x IS NOT NULL")
    low = lambda p: F.floor(p * (F.col("n") - 1)).cast("long")
    needed = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(low(p), F.least(low(p) + 1, F.col("n") - 1)))))
    targets = written(groups.filter("n > 0").select("g", "c", F.explode(needed).alias("k")))
    counts = x.groupBy("g", "c", _power(F.col("x")).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    now = written(_placed(targets, counts.withColumn("below", F.lit(0).cast("long")), ["g", "c"]))
    done = None
    while True:
        narrow = now.filter((F.col("n") <= room) | (F.col("lo") == F.col("hi")))
        done = narrow if done is None else done.unionByName(narrow)
        wide = now.filter((F.col("n") > room) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        spans = wide.select("g", "c", "lo", "hi", F.col("below").alias("below")).distinct()
        step = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        binned = _with_spans(x, spans).groupBy("g", "c", F.col("lo").alias("span"), "below", step.alias("bin"))
        counts = binned.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        now = written(_placed(wide.select("g", "c", "k", F.col("lo").alias("span")), counts, ["g", "c", "span"]))
    settled = done.filter("lo = hi").select("g", "c", "k", F.col("lo").alias("x"))
    rest = done.filter("lo < hi")
    inside = _with_spans(x, rest.select("g", "c", "lo", "hi").distinct()).groupBy("g", "c", "lo").agg(F.array_sort(F.collect_list("x")).alias("s"))  # room at most
    picked = rest.join(inside, ["g", "c", "lo"]).select("g", "c", "k", F.get("s", (F.col("k") - F.col("below")).cast("int")).alias("x"))
    return settled.unionByName(picked).groupBy("g", "c").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("values"))
