"""Distribution statistics, densities, fits and bins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .order_stats import quantile_table

#: Values of a group that are sorted at once.
ROOM = 100_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float] = (0.25, 0.5, 0.75), prefix: str = "q", room: int = ROOM) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each."""
    found = quantile_table(df, keys, {value: at}, room).withColumnRenamed(value, "__q")
    return found.select(*keys, *(F.get("__q", F.lit(i)).alias(f"{prefix}{round(100 * p)}") for i, p in enumerate(at)))


def whole_quantiles(df: DataFrame, columns: Mapping[str, Sequence[float]], room: int = ROOM) -> dict[str, list[float | None]]:
    """A15 of a whole table: exact quantiles of several columns in the same passes; the
    quantiles are all that is collected."""
    found = quantile_table(df, [], columns, room).first()
    return {c: list(found[c]) if found and found[c] else [None] * len(at) for c, at in columns.items()}


def variation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The coefficient of variation in per cent from the sample deviation;
    groups of one value have none and fall out."""
    out = df.groupBy(*keys).agg((F.try_divide(F.stddev_samp(value), F.avg(value)) * 100).alias("cv_pct"))
    return out.dropna(subset=["cv_pct"])


def pair_correlation(df: DataFrame, keys: Sequence[str], at: Sequence[str], member: str, a: str, b: str, value: str, least: int = 6) -> DataFrame:
    """Pearson correlation of two members' series; series with fewer common
    points than ``least`` or without spread fall out."""
    pick = lambda m: F.avg(F.when(F.col(member) == m, F.col(value)))
    wide = df.groupBy(*keys, *at).agg(pick(a).alias("__a"), pick(b).alias("__b")).dropna(subset=["__a", "__b"])
    out = wide.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("correlation"), F.stddev_samp("__a").alias("__sa"), F.stddev_samp("__b").alias("__sb"))
    return out.filter((F.col("n") >= least) & (F.col("__sa") > 0) & (F.col("__sb") > 0)).drop("__sa", "__sb")


def density(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, points: int = 30, log: bool = False, least: int = 3) -> DataFrame:
    """A21, A21b, A21d: Gaussian kernel density on a fixed grid, with Scott's
    bandwidth; groups of fewer than ``least`` values or without spread fall out.

    A group's sums at all points of the grid are one row of aggregates, so a value is
    never dealt to the points; the sums are exact.  The values are written once while the
    result is being built."""
    x = F.log10(value) if log else F.col(value)
    rows = written(df.select(*keys, x.alias("__x")).dropna(subset=["__x"]))  # read for the bandwidth, and again
    shape = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("__x").alias("__sd")).filter((F.col("n") >= least) & (F.col("__sd") > 0))
    h = shape.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", (F.col("__sd") * F.pow("n", F.lit(-0.2))).alias("bandwidth"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.join(h, reduce(lambda a, b: a & b, same))
    at = [low + (high - low) * i / float(points - 1) for i in range(points)]
    terms = (F.exp(-0.5 * ((F.lit(g) - F.col("__x")) / F.col("bandwidth")) ** 2) for g in at)
    sums = met.groupBy(*keys, "n", "bandwidth").agg(*(F.sum(t).alias(f"__{i}") for i, t in enumerate(terms)))
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("point"), F.lit(g).alias("x"), F.col(f"__{i}").alias("s")) for i, g in enumerate(at))))
    out = sums.select(*keys, "n", "bandwidth", grid.alias("g"))
    return out.select(*keys, "g.point", "g.x", "n", "bandwidth", (F.col("g.s") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))


def nested_violins(df: DataFrame, keys: Sequence[str], member: str, members: Sequence, value: str, low: float, high: float, points: int = 30, width: float = 0.42, log: bool = False, least: int = 3) -> DataFrame:
    """Densities of the members of each group (years of a scenario) times the number
    of their values, at one scale for the group: the widest reaches ``width``.  A group in
    which any of the members has fewer than ``least`` values, or no spread, is left out."""
    rows = df.filter(F.col(member).isin(list(members)))
    found = density(rows, [*keys, member], value, low, high, points, log, least).withColumn("__d", F.col("density") * F.col("n"))
    scale = found.groupBy(*keys).agg(F.count_distinct(member).alias("__members"), F.max("__d").alias("__top")).filter(F.col("__members") == len(members))
    return found.join(scale, list(keys)).withColumn("width", F.try_divide(F.col("__d"), F.col("__top")) * width).drop("__d", "__top", "__members")


def to_own_peak(densities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Densities as shares of their group's highest, 1 at the peak."""
    top = densities.groupBy(*keys).agg(F.max("density").alias("__top"))  # a row for each group
    return densities.join(top, list(keys)).withColumn("share", F.try_divide("density", "__top")).drop("__top")


def median_trend(df: DataFrame, keys: Sequence[str], member: str, members: Sequence[str], within: Sequence[str], value: str, log: bool = False) -> DataFrame:
    """The line through the medians of the members, and of what is told apart
    ``within`` them, against the members' positions.  A22c: of a filtered table."""
    medians = quantiles(df, [*keys, member, *within], value, (0.5,))
    at = F.array_position(F.array(*map(F.lit, members)), F.col(member)) - 1
    return trend(medians.filter(F.col(member).isin(list(members))).withColumn("__at", at.cast("double")), keys, "__at", "q50", log)


def trend(df: DataFrame, keys: Sequence[str], x: str, y: str, log: bool = False) -> DataFrame:
    """Least-squares line, of log10 y where asked."""
    v = F.log10(y) if log else F.col(y)
    return df.groupBy(*keys).agg(F.regr_slope(v, F.col(x)).alias("slope"), F.regr_intercept(v, F.col(x)).alias("intercept"), F.count(y).alias("n"))


def fixed_bins(df: DataFrame, bins: DataFrame, value: str, low: float, width: float, measure: str, room: int = ROOM) -> DataFrame:
    """Bins open at the left and closed at the right; bins (column bin, from 1)
    without rows are kept, the lowest edge itself falls out."""
    at = F.ceil((F.col(value) - low) / width).cast("int")
    binned = df.select(F.when(F.col(value) > low, at).alias("bin"), F.col(measure).alias("m")).dropna(subset=["bin"])
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    found = counts.join(quantiles(binned, ["bin"], "m", room=room), "bin", "left")
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "q25", "q50", "q75")


def decile_bins(df: DataFrame, value: str, measure: str, room: int = ROOM) -> DataFrame:
    """Bins by the value's deciles, the lowest edge widened by 1e-9; equal edges
    make one bin."""
    edges = sorted({e for e in whole_quantiles(df, {value: [i / 10 for i in range(11)]}, room)[value] if e is not None})
    x = F.col(value)
    at = sum(((F.lit(e) < x).cast("int") for e in edges[1:]), (F.lit(edges[0] - 1e-9) < x).cast("int")) if edges else F.lit(1)
    binned = df.dropna(subset=[value]).select(F.greatest(at, F.lit(1)).alias("bin"), F.col(measure).alias("m"))
    return binned.groupBy("bin").agg(F.count("*").alias("n")).join(quantiles(binned, ["bin"], "m", (0.5,), room=room), "bin")
