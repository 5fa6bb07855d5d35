"""Comparisons of scenarios, years and deployments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .stats import whole_quantiles


def pivoted(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str, prefix: str) -> DataFrame:
    """One column for each of the given values; duplicates are
    averaged, as a pivot table does."""
    pick = lambda v: F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}")
    return df.groupBy(*keys).agg(*map(pick, values))


def percent_change(now: Column, base: Column) -> Column:
    """NULL where the base is 0 or missing."""
    return F.try_divide(now - base, base) * 100.0


def change_vs_base(df: DataFrame, keys: Sequence[str], value: str, base_year: int, year: str = "year") -> DataFrame:
    """Absolute and relative difference of every year from the base."""
    base = F.max(F.when(F.col(year) == base_year, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("base", base).withColumns({"delta": F.col(value) - F.col("base"), "delta_pct": percent_change(F.col(value), F.col("base"))})


def increments(df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int], relative: bool = False) -> DataFrame:
    """The first year's value and the growth to each next one, a fall counting
    as 0 and a missing year as value 0, with their total.  W4b, relative: shares of
    the last year's value, all 0 where that isn't positive."""
    at = lambda y: F.coalesce(F.max(F.when(F.col("year") == y, F.col(value))), F.lit(0.0))
    wide = df.groupBy(*keys).agg(*(at(y).alias(f"__{y}") for y in years))
    parts = [F.col(f"__{years[0]}")] + [F.greatest(F.col(f"__{b}") - F.col(f"__{a}"), F.lit(0.0)) for a, b in zip(years, years[1:], strict=False)]
    if relative:
        last = F.col(f"__{years[-1]}")
        parts = [F.when(last > 0, F.try_divide(p, last)).otherwise(0.0) for p in parts]
    out = wide.select(*keys, *(p.alias(f"seg_{y}") for p, y in zip(parts, years, strict=True)))
    return out.withColumn("total", sum((F.col(f"seg_{y}") for y in years[1:]), F.col(f"seg_{years[0]}")))


def covered_increments(df: DataFrame, keys: Sequence[str], inside: str, total: str, years: Sequence[int]) -> DataFrame:
    """W4b of coverage: increments of the covered value over the last year's total."""
    at = lambda c, y: F.coalesce(F.max(F.when(F.col("year") == y, F.col(c))), F.lit(0.0))
    wide = df.groupBy(*keys).agg(*(at(inside, y).alias(f"__{y}") for y in years), at(total, years[-1]).alias("__all"))
    steps = [F.col(f"__{years[0]}")] + [F.greatest(F.col(f"__{b}") - F.col(f"__{a}"), F.lit(0.0)) for a, b in zip(years, years[1:], strict=False)]
    out = [F.when(F.col("__all") > 0, F.try_divide(s, F.col("__all"))).otherwise(0.0).alias(f"seg_{y}") for s, y in zip(steps, years, strict=True)]
    return wide.select(*keys, *out).withColumn("coverage", sum((F.col(f"seg_{y}") for y in years[1:]), F.col(f"seg_{years[0]}")))


def relative_to_member(df: DataFrame, keys: Sequence[str], member: str, reference: str, value: str, scale: float = 100.0) -> DataFrame:
    """Each member as a share of the reference one; groups whose reference is
    not positive are left out."""
    base = F.max(F.when(F.col(member) == reference, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("reference", base).filter("reference > 0").withColumn("relative", F.col(value) / F.col("reference") * scale)


def deviation_from_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per cent above or below the group's mean."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return df.withColumn("deviation_pct", (F.try_divide(F.col(value), mean) - 1.0) * 100.0)


def pair_difference(df: DataFrame, keys: Sequence[str], member: str, a: str, b: str, value: str) -> DataFrame:
    """Value of member b less that of a."""
    wide = pivoted(df, keys, member, [a, b], value, "m_")
    return wide.withColumn("difference", F.col(f"m_{b}") - F.col(f"m_{a}"))


def quadrants(df: DataFrame, panel: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Rows by panel and quadrant about the pooled medians, with counts and
    shares of the panel's weight."""
    df = written(df.select(*dict.fromkeys([*panel, x, y, weight])))  # counted here, and again below
    medians = whole_quantiles(df, {c: [0.5] for c in (x, y)})
    x_cut, y_cut = (F.lit(medians[c][0]).cast("double") for c in (x, y))
    label = F.concat(F.when(F.col(x) >= x_cut, "high_").otherwise("low_"), F.when(F.col(y) >= y_cut, "high").otherwise("low"))
    found = df.withColumn("quadrant", label).groupBy(*panel, "quadrant").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    return found.withColumn("share_pct", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy(*panel))) * 100.0)


def decomposition(df: DataFrame, keys: Sequence[str], value: str, reference: str = "ssp126", targets: Sequence[str] = ("ssp245", "ssp585")) -> DataFrame:
    """The change from the reference pathway as climate, deployment and their
    interaction; a missing entry of the matrix makes its terms NULL."""
    at = lambda w, p: F.max(F.when((F.col("climate_ssp") == w) & (F.col("deploy_ssp") == p), F.col(value)))
    cells = [(reference, reference)] + [c for t in targets for c in ((t, t), (t, reference), (reference, t))]
    wide = df.groupBy(*keys).agg(*(at(w, p).alias(f"{w}|{p}") for w, p in cells))
    base = F.col(f"`{reference}|{reference}`")
    rows = F.array(
        *(
            F.struct(
                F.lit(t).alias("target_ssp"), F.col(f"`{t}|{t}`").alias("target_total_risk"), (F.col(f"`{t}|{t}`") - base).alias("total_change"),
                (F.col(f"`{t}|{reference}`") - base).alias("climate_effect"), (F.col(f"`{reference}|{t}`") - base).alias("deployment_effect"),
            )
            for t in targets
        )
    )
    out = wide.select(*keys, base.alias("baseline_risk"), F.explode(rows).alias("r")).select(*keys, F.lit(reference).alias("reference_ssp"), F.lit(value).alias("risk_metric"), "baseline_risk", "r.*")
    return out.withColumn("interaction_effect", F.col("total_change") - F.col("climate_effect") - F.col("deployment_effect"))
