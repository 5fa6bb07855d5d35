"""Zero and missing values in gridded inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import activation_bucket, known, quality_status, ratio_floor_one, zero_or_missing


def status_counts(df: DataFrame, keys: Sequence[str], value: str, covered: Column) -> DataFrame:
    """Bad, ok and uncovered rows, and the bad share of the covered ones."""
    s = quality_status(F.col(value), covered)
    out = df.withColumn("__s", s).groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("__s") == k).alias(f"n_{k}") for k in ("bad", "ok", "nodata")))
    return out.withColumn("bad_ratio", F.try_divide(F.col("n_bad"), F.col("n_bad") + F.col("n_ok")))


def zero_by_country(df: DataFrame, value: str, country: str = "country", outside: str = "outside") -> DataFrame:
    """Rows, zero or missing ones and their ratio by country; rows without a
    country count as outside, countries without rows have none."""
    name = F.coalesce(country, F.lit(outside))
    out = df.groupBy(name.alias(country)).agg(F.count("*").alias("n"), F.count_if(zero_or_missing(F.col(value))).alias("n_bad"))
    return out.withColumn("ratio", F.col("n_bad") / F.col("n"))


def agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """How two sources agree on bad values, with the Jaccard index."""
    x, y = zero_or_missing(F.col(a)), zero_or_missing(F.col(b))
    out = df.groupBy(*keys).agg(F.count_if(x & y).alias("both_bad"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("both_ok"))
    return out.withColumn("jaccard", ratio_floor_one(F.col("both_bad"), F.col("both_bad") + F.col("only_a") + F.col("only_b")))


def by_denominator(df: DataFrame, value: str, family: str, families: dict[str, Sequence[str]]) -> DataFrame:
    """Bad counts under several choices of the rows that count."""
    bad = zero_or_missing(F.col(value))
    one = lambda name, own: F.struct(F.lit(name).alias("denominator"), F.count_if(own).alias("n"), F.count_if(own & bad).alias("n_bad"))
    counts = df.agg(F.array(*(one(name, F.col(family).isin(list(members))) for name, members in families.items())).alias("counts"))
    return counts.select(F.inline("counts")).withColumn("ratio", ratio_floor_one(F.col("n_bad"), F.col("n")))


def missing_by_surface(df: DataFrame, keys: Sequence[str], value: str, sea: str) -> DataFrame:
    """Missing values on land and at sea."""
    gone = F.col(value).isNull()
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(gone).alias("n_missing"), F.count_if(gone & F.col(sea)).alias("n_sea"), F.count_if(gone & ~F.col(sea)).alias("n_land"), F.count_if(F.col(sea)).alias("sea_cells")
    )
    return out.withColumns({"land_share": ratio_floor_one(F.col("n_land"), F.col("n_missing")), "sea_share": ratio_floor_one(F.col("sea_cells"), F.col("n"))})


def zero_cf_stations(power: DataFrame, stations: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    """Active stations with capacity and data whose power is
    0 all through the year, by the target year from which they count.  A station
    without data isn't one with zero; a file without such stations has no rows."""
    value = known(F.col("power_gw"))
    own = power.filter(F.col("year") == year).groupBy(*keys, "station_idx").agg(F.sum(value).alias("total"), F.count(value).alias("n_known"))
    able = stations.filter((F.col("capacity_gw") > 0) & (F.col("activation_year") <= year))
    return own.filter("n_known > 0 and total = 0").join(able, "station_idx").select(*keys, "station_idx", activation_bucket(F.col("activation_year")).alias("bucket"))


def missing_mask(grid: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Whether a cell's mean over time is missing; no rows, no mask."""
    return grid.groupBy(*keys).agg(F.avg(known(F.col(value))).isNull().alias("missing"))
