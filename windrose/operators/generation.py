"""Capacity factors and generation of stations and countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, known
from ..functions import constants as K
from ..sources.scratch import written

#: Columns that tell the power files apart.
FILE_KEYS = ["technology", "climate_ssp"]


def power_figures(power: DataFrame, by: Sequence[str], keys: Sequence[str] = FILE_KEYS) -> tuple[DataFrame, DataFrame]:
    """By file keys and period, each station's sum of known values and their
    number, and the time steps that occur.  Both come from one scan and one aggregation,
    which is written while the result is being built."""
    value = known(F.col("power_gw"))
    groups = [*keys, *by]
    both = power.groupingSets([[*groups, "station_idx"], [*groups, "step_idx"]], *groups, "station_idx", "step_idx")
    both = written(both.agg(F.grouping("station_idx").alias("__step"), F.sum(value).alias("total"), F.count(value).alias("n_known")))
    return both.filter("__step = 0").select(*groups, "station_idx", "total", "n_known"), both.filter("__step = 1").select(*groups, "step_idx")


def yearly_figures(sums: DataFrame, steps: DataFrame, keys: Sequence[str] = FILE_KEYS) -> tuple[DataFrame, DataFrame]:
    """The same by year from those by month."""
    year = sums.groupBy(*keys, "year", "station_idx").agg(F.sum("total").alias("total"), F.sum("n_known").alias("n_known"))
    return year, steps.select(*keys, "year", "step_idx").distinct()


def from_figures(sums: DataFrame, steps: DataFrame, stations: DataFrame, by: Sequence[str] = ("year",), keys: Sequence[str] = FILE_KEYS, dt_hours: float = 3.0) -> DataFrame:
    """See ``station_period``."""
    keys, by = list(keys), list(by)
    counted = steps.groupBy(*keys, *by).agg(F.count("*").alias("n_steps"))
    if "month" in by:  # data in any month of the year make the others count as 0
        year = sums.groupBy(*keys, "station_idx", "year").agg(F.sum("n_known").alias("n_year"))
        sums = sums.join(year, [*keys, "station_idx", "year"]).withColumn("n_known", F.col("n_year"))
    able = stations.filter((F.col("capacity_gw") > 0) & F.col("country").isNotNull())
    own = ["station_idx", *(k for k in keys if k in stations.columns)]
    met = sums.filter("n_known > 0").join(able, own).filter(F.col("activation_year") <= F.col("year")).join(counted, [*keys, *by])
    total = F.coalesce("total", F.lit(0.0))
    return met.select(
        *keys, "station_idx", *by, "country", F.col("n_steps"), (F.col("capacity_gw") * 1000).alias("capacity_mw"),
        (total / (F.col("n_steps") * F.col("capacity_gw"))).alias("capacity_factor"), (total * dt_hours * 1000).alias("generation_mwh"),
    )


def station_period(power: DataFrame, stations: DataFrame, by: Sequence[str] = ("year",), keys: Sequence[str] = FILE_KEYS, dt_hours: float = 3.0, time: DataFrame | None = None) -> DataFrame:
    """Capacity factor and generation of each station and
    period (year, or year and month).

    power: keys, station_idx, year, month, step_idx, power_gw; stations:
    station_idx, capacity_gw, activation_year, country, and those of the keys that
    tell stations apart.  The denominator is the
    number of time steps of the file in the period, missing ones included.  A
    station counts if it is active in the year, has data in the year, a positive
    capacity and a country.

    power is scanned once, see ``power_figures``.  time: keys, year, month, step_idx of
    each step, where such a table exists; then nothing is written."""
    keys, by = list(keys), list(by)
    if time is None:
        sums, steps = power_figures(power, by, keys)
    else:
        value = known(F.col("power_gw"))
        sums = power.groupBy(*keys, "station_idx", *by).agg(F.sum(value).alias("total"), F.count(value).alias("n_known"))
        steps = time.select(*keys, *by, "step_idx").distinct()
    return from_figures(sums, steps, stations, by, keys, dt_hours)


def with_output_rounding(df: DataFrame) -> DataFrame:
    """the decimals of the published tables."""
    return df.withColumns({"capacity_mw": half_even(F.col("capacity_mw"), 4), "capacity_factor": half_even(F.col("capacity_factor"), 6), "generation_mwh": half_even(F.col("generation_mwh"), 3)})


def country_annual(stations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and the arithmetic mean of the capacity factor by country."""
    groups = ["country", *keys]
    valid = stations.filter(F.coalesce(*(F.when(F.col(k).isNull(), True) for k in groups), F.lit(False)) == False)  # noqa: E712
    return valid.groupBy(*groups).agg(F.sum("capacity_mw").alias("capacity_mw"), F.sum("generation_mwh").alias("generation_mwh"), F.avg("capacity_factor").alias("mean_cf"))


def check_table(countries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Countries, sums in GW and TWh, and the mean of the mean factors."""
    return countries.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum("capacity_mw") / 1e3).alias("capacity_gw"), (F.sum("generation_mwh") / 1e6).alias("generation_twh"), F.avg("mean_cf").alias("mean_cf"))


def weighted_cf(stations: DataFrame, keys: Sequence[str], hours: float | None = None, scale: float = 1.0) -> DataFrame:
    """A4 with hours: generation over capacity times hours.  A5 without: the mean
    of the capacity factor weighted with capacity."""
    top = F.sum("generation_mwh") if hours else F.sum(F.col("capacity_mw") * F.col("capacity_factor"))
    low = F.sum("capacity_mw") * hours if hours else F.sum("capacity_mw")
    return stations.groupBy(*keys).agg(F.sum("capacity_mw").alias("capacity_mw"), F.sum("generation_mwh").alias("generation_mwh"), (F.try_divide(top, low) * scale).alias("weighted_cf"))


def totals(df: DataFrame, keys: Sequence[str], value: str, unit: float = 1.0) -> DataFrame:
    """The sum by group in another unit."""
    return df.groupBy(*keys).agg((F.sum(value) / unit).alias(value))


def coherent(df: DataFrame) -> DataFrame:
    """Deployment and climate follow the same scenario."""
    return df.filter(F.col("deploy_ssp") == F.col("climate_ssp"))


def fixed_fleet(df: DataFrame, ssp: str = "ssp245") -> DataFrame:
    """One deployment under every climate."""
    return df.filter(F.col("deploy_ssp") == ssp)


def positive(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all columns are above 0; NaN doesn't count as such."""
    for c in columns:
        df = df.filter(known(F.col(c)) > 0)
    return df


def window_change(df: DataFrame, keys: Sequence[str], value: str, base: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """The difference of two window means, for keys that have both; both come
    from one aggregation."""
    mean = lambda w: F.avg(F.when(F.col("year").between(*w), F.col(value)))
    both = df.filter(F.col("year").between(*base) | F.col("year").between(*target)).groupBy(*keys).agg(mean(base).alias("base"), mean(target).alias("target"))
    return both.dropna(subset=["base", "target"]).withColumn("change", F.col("target") - F.col("base"))


def padded_range(df: DataFrame, keys: Sequence[str], value: str, pad: float = 0.08, log: bool = False) -> DataFrame:
    """Minimum and maximum with a margin; of log10 where asked."""
    x: Column = F.log10(value) if log else F.col(value)
    found = df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    gap = (F.col("high") - F.col("low")) * pad
    return found.withColumns({"low": F.col("low") - gap, "high": F.col("high") + gap})


def shared_limits(df: DataFrame, factors: dict[str, tuple[float, float]]) -> DataFrame:
    """A range for all panels, the whole table's minimum and maximum of each
    column times their factors."""
    return df.agg(*(x for c, (low, high) in factors.items() for x in ((F.min(c) * low).alias(f"{c}_low"), (F.max(c) * high).alias(f"{c}_high"))))


def rms_wind(df: DataFrame, keys: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Root of the sum of the mean squares of two components."""
    square = lambda c: F.avg(known(F.col(c)) * known(F.col(c)))
    return df.groupBy(*keys).agg(F.sqrt(square(u) + square(v)).alias("speed"))


def time_mean(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The mean over time, missing values left out."""
    return df.groupBy(*keys).agg(F.avg(known(F.col(value))).alias(value))


HOURS = K.HOURS
