"""Coverage of stations and capacity by areas and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio_or_zero, sum_or_zero


def coverage_measures(inside: Column, capacity: Column) -> list[Column]:
    """Counts and sums; ratios follow from the sums."""
    return [
        F.count("*").alias("n_total"), F.count_if(inside).alias("n_inside"), sum_or_zero(capacity).alias("cap_total"), sum_or_zero(F.when(inside, capacity)).alias("cap_inside"),
    ]


def with_ratios(df: DataFrame) -> DataFrame:
    """Ratios of sums, 0 where the denominator is 0."""
    return df.withColumns({"n_cover_ratio": ratio_or_zero(F.col("n_inside"), F.col("n_total")), "cap_cover_ratio": ratio_or_zero(F.col("cap_inside"), F.col("cap_total"))})


def coverage(df: DataFrame, keys: Sequence[str], inside: str = "inside", capacity: str = "capacity_gw") -> DataFrame:
    """A8, A8c, A8e: coverage by group."""
    return with_ratios(df.groupBy(*keys).agg(*coverage_measures(F.col(inside), F.col(capacity))))


def coverage_with_total(df: DataFrame, detail: str, fixed: Sequence[str] = (), total: str = "ALL", inside: str = "inside", capacity: str = "capacity_gw") -> DataFrame:
    """One row for each value of detail and one named ``total``,
    in each group of the fixed columns; no row is added across those."""
    sets = [[*fixed, detail], list(fixed)]
    found = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in (*fixed, detail))).agg(F.grouping(detail).alias("__all"), *coverage_measures(F.col(inside), F.col(capacity)))
    return with_ratios(found.withColumn(detail, F.when(F.col("__all") == 1, total).otherwise(F.col(detail).cast("string"))).drop("__all"))


def dense_regions(df: DataFrame, regions: DataFrame, key: str = "region_id") -> DataFrame:
    """Every region, with zeros where it has no row; background (0) has none."""
    measures = [c for c in df.columns if c != key]
    return regions.join(df.filter(F.col(key) > 0), key, "left").fillna(0, measures)


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of the first table that the second lacks."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def on_keys(dimension: DataFrame, df: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """One row for each key of the dimension, filled where asked."""
    out = dimension.join(df, list(keys), "left")
    return out.fillna(fill) if fill else out
