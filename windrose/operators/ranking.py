"""Orders and selections for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import arrow, known


def top(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """T-1: the n largest, ties by name."""
    return df.orderBy(F.desc(value), tie).limit(n)


def extremes(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """T-2: the n smallest and the n largest, marked; short tables have rows in both."""
    low = df.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("bottom"))
    high = df.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    return low.unionByName(high)


def row_mean(*columns: str) -> Column:
    """T-3: the mean of the columns that have a value."""
    values = F.filter(F.array(*(known(F.col(c)) for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def ordered(df: DataFrame, score: str, tie: str, descending: bool = True) -> DataFrame:
    """T-4, T-5, T-6, T-7, T-9: by score, equal scores by the tie column (a stable order)."""
    return df.orderBy(F.desc(score) if descending else F.asc(score), tie)


def preferred(df: DataFrame, name: str, preference: Sequence[str]) -> DataFrame:
    """T-8: names of the preference list first, in its order, then by name."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col(name))
    return df.orderBy(F.when(rank > 0, rank).otherwise(len(preference) + 1), name)


def labelled(df: DataFrame, name: str, now: str, then: str, margin: float, threshold: float) -> DataFrame:
    """Names with arrows where coverage moved, and which are below a threshold."""
    return df.withColumns({"label": F.concat(name, arrow(F.col(now), F.col(then), margin)), "below": F.col(now) < threshold})
