"""Extreme weather: exposure, losses, risk tables and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import clip, lookup, ratio_or_null
from ..sources.scratch import written
from .order_stats import quantile_table

STATION_KEYS = ["station_id", "country", "technology", "deploy_ssp", "climate_ssp", "target_year"]
COUNTRY_KEYS = ["country", "technology", "deploy_ssp", "climate_ssp", "target_year", "event_type"]


def exposures(stations: DataFrame, annual: DataFrame, hazard: DataFrame, local: Column | float = 1.0, noise: Column | float = 1.0) -> DataFrame:
    """Hours, capacity hours and generation of each station that
    lie in each kind of event.

    local, noise: the station's factor on the hazard and on the exposed generation."""
    met = annual.join(stations.select("station_id", "station_extreme_weather_index"), "station_id").join(hazard, ["country", "climate_ssp", "target_year", "technology"])
    hours = clip(F.col("event_frequency_hours_per_year") * F.col("station_extreme_weather_index") * local, *K.EXPOSED_HOURS_RANGE)
    out = met.withColumn("exposed_hours", hours)
    return out.select(
        *STATION_KEYS, "event_type", "capacity_mw", "exposed_hours", (F.col("capacity_mw") * F.col("exposed_hours")).alias("exposed_capacity_mw_hours"),
        (F.col("annual_generation_mwh") * F.col("exposed_hours") / K.HOURS * noise).alias("exposed_generation_mwh"), "event_intensity_index",
    )


def country_exposure(exposure: DataFrame) -> DataFrame:
    """A24."""
    return exposure.groupBy(*COUNTRY_KEYS).agg(
        F.sum("exposed_capacity_mw_hours").alias("exposed_capacity_mw_hours"), F.sum("exposed_generation_mwh").alias("exposed_generation_mwh"), F.avg("exposed_hours").alias("mean_exposed_hours"), F.avg("event_intensity_index").alias("mean_event_intensity_index")
    )


def losses(exposure: DataFrame, annual: DataFrame, noise: Column | float = 1.0, normal: Column | float = 1.0) -> DataFrame:
    """Losses of each station and event; noise, normal: factors on
    vulnerability and on the capacity factor in the event."""
    keys = ["station_id", "deploy_ssp", "climate_ssp"]
    met = exposure.join(annual.select(*keys, "annual_generation_mwh", "annual_capacity_factor"), keys)
    vulnerability = clip(lookup(F.col("event_type"), K.EVENT_VULNERABILITY) * (1.0 + K.VULNERABILITY_PER_INTENSITY * F.col("event_intensity_index")) * noise, *K.VULNERABILITY_RANGE)
    tiny = F.lit(K.TINY)
    out = met.withColumn("vulnerability_loss_fraction", vulnerability).withColumn("loss_mwh", F.col("exposed_generation_mwh") * F.col("vulnerability_loss_fraction"))
    out = out.withColumn("conditional_loss_rate", F.col("loss_mwh") / F.greatest("exposed_generation_mwh", tiny)).withColumn("cf_normal_during_event", F.col("annual_capacity_factor") * normal)
    return out.select(
        *STATION_KEYS, "event_type", "capacity_mw", "annual_generation_mwh", "exposed_generation_mwh", "cf_normal_during_event",
        F.greatest(F.col("cf_normal_during_event") * (1.0 - F.col("conditional_loss_rate")), F.lit(0.0)).alias("cf_actual_during_event"), "vulnerability_loss_fraction", "loss_mwh",
        (F.col("loss_mwh") / F.greatest("annual_generation_mwh", tiny)).alias("annual_loss_rate"), "conditional_loss_rate", (F.col("loss_mwh") / F.greatest("capacity_mw", tiny)).alias("unit_capacity_loss_mwh_per_mw"),
    )


def _sums(*names: str):
    return [F.sum(n).alias(n) for n in names]


def _loss_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "annual_loss_rate": ratio_or_null(F.col("loss_mwh"), F.col("annual_generation_mwh")),
            "conditional_loss_rate": ratio_or_null(F.col("loss_mwh"), F.col("exposed_generation_mwh")),
            "unit_capacity_loss_mwh_per_mw": ratio_or_null(F.col("loss_mwh"), F.col("capacity_mw")),
        }
    )


def country_losses(station_losses: DataFrame, keys: Sequence[str] = COUNTRY_KEYS) -> DataFrame:
    """Sums and ratios of sums by country and event."""
    return _loss_rates(station_losses.groupBy(*keys).agg(*_sums("capacity_mw", "annual_generation_mwh", "exposed_generation_mwh", "loss_mwh")))


def risk_matrix(by_event: DataFrame) -> DataFrame:
    """Sums over events.  A station's capacity and generation count once
    for each of its technology's events, as in the tables that this reproduces."""
    out = by_event.groupBy("country", "technology", "target_year", "climate_ssp", "deploy_ssp").agg(*_sums("capacity_mw", "annual_generation_mwh", "loss_mwh"))
    return out.withColumns(
        {
            "loss_rate": ratio_or_null(F.col("loss_mwh"), F.col("annual_generation_mwh")),
            "unit_capacity_loss_mwh_per_mw": ratio_or_null(F.col("loss_mwh"), F.col("capacity_mw")),
            "unit_generation_loss_mwh_per_gwh": ratio_or_null(F.col("loss_mwh"), F.col("annual_generation_mwh") / 1000),
        }
    )


def risk_classes(df: DataFrame, groups: Sequence[str], generation: str, risk: str) -> DataFrame:
    """Each row against its group's medians; an equal value counts as high."""
    df = written(df)  # the medians are of the same rows
    medians = quantile_table(df, groups, {generation: [0.5], risk: [0.5]})
    own = medians.select(*(F.col(k).alias(f"__{k}") for k in groups), F.get(generation, F.lit(0)).alias("__generation"), F.get(risk, F.lit(0)).alias("__risk"))
    met = df.join(own, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in groups)), "left")
    high = lambda c, cut: F.coalesce(F.col(c) >= F.col(cut), F.lit(False))
    label = F.concat(F.when(high(generation, "__generation"), "high").otherwise("low"), F.lit("_generation_"), F.when(high(risk, "__risk"), "high").otherwise("low"), F.lit("_risk"))
    return met.select(*df.columns, label.alias("risk_class"))


def country_profile(matrix: DataFrame) -> DataFrame:
    """A27, W1 on the pathways where deployment and climate agree."""
    actual = matrix.filter("climate_ssp = deploy_ssp").withColumnRenamed("climate_ssp", "ssp").drop("deploy_ssp")
    out = actual.groupBy("country", "ssp", "target_year").agg(*_sums("capacity_mw", "annual_generation_mwh", "loss_mwh"))
    out = out.withColumns({"loss_rate": ratio_or_null(F.col("loss_mwh"), F.col("annual_generation_mwh")), "unit_capacity_loss_mwh_per_mw": ratio_or_null(F.col("loss_mwh"), F.col("capacity_mw"))})
    return risk_classes(out, ["ssp", "target_year"], "annual_generation_mwh", "loss_rate")


def share_of_group(df: DataFrame, groups: Sequence[str], value: str, total: str, share: str) -> DataFrame:
    """The group's total on each row and the row's share, NULL if it is 0."""
    return df.withColumn(total, F.sum(value).over(Window.partitionBy(*groups))).withColumn(share, ratio_or_null(F.col(value), F.col(total)))


def event_contribution(by_event: DataFrame) -> DataFrame:
    """events' shares of each country's losses."""
    actual = by_event.filter("climate_ssp = deploy_ssp").withColumnRenamed("climate_ssp", "ssp")
    out = actual.groupBy("country", "ssp", "target_year", "technology", "event_type").agg(*_sums("loss_mwh", "annual_generation_mwh", "capacity_mw"))
    return share_of_group(out, ["country", "ssp", "target_year"], "loss_mwh", "country_total_loss_mwh", "event_loss_contribution_fraction")


def technology_vulnerability(by_event: DataFrame) -> DataFrame:
    """Losses by country and technology."""
    actual = by_event.filter("climate_ssp = deploy_ssp").withColumnRenamed("climate_ssp", "ssp")
    return country_losses(actual, ["country", "ssp", "target_year", "technology"])
