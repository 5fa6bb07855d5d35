"""Scalar expressions: Column in, Column out, all inside code generation.

T13: division by zero raises in ANSI mode, so every ratio here goes through
try_divide or has a floor.  T15: measures are doubles throughout.  T16: the 560
code of one source is ssp585 (see ssp_code).
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def known(x: Column) -> Column:
    """NaN as NULL, since Spark counts NaN and orders it above all numbers."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """P10: neither NULL, NaN nor infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def zero_or_missing(x: Column) -> Column:
    """P11."""
    return x.isNull() | F.isnan(x) | (x == 0)


def clip(x: Column, low, high) -> Column:
    """F10; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    """F11."""
    return 1.0 / (1.0 + F.exp(-x))


def lookup(key: Column, values: Mapping) -> Column:
    """The value of a key in a small fixed table, else NULL."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())), key)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ratio_floor_one(a: Column, b: Column) -> Column:
    """A / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def ratio_or_null(a: Column, b: Column) -> Column:
    """A / b, NULL where b is 0."""
    return F.try_divide(a, b)


def sum_or_zero(x: Column) -> Column:
    """The sum of nothing is 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def half_even(x: Column, digits: int) -> Column:
    """F18, T12."""
    return F.bround(x, digits)


def ssp_code(name: Column) -> Column:
    """F16: any spelling of a scenario as ssp126, ssp245 or ssp585; the 5-6.0 forms
    count as ssp585, other three-digit codes stay, anything else is unchanged."""
    s = F.lower(name)
    other = F.regexp_extract(s, r"ssp(\d{3})", 1)
    return (
        F.when(s.rlike("1.?2.?6"), "ssp126")
        .when(s.rlike("2.?4.?5"), "ssp245")
        .when(s.rlike("5.?8.?5") | s.rlike("5.?6.?0"), "ssp585")
        .when(other != "", F.concat(F.lit("ssp"), other))
        .otherwise(name)
    )


def ssp_from_path(path: Column) -> Column:
    """The scenario named in a path, else the file's stem without its prefix."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    found = F.regexp_extract(F.lower(path), r"(ssp[\d.\-]+)", 1)
    return F.when(found != "", ssp_code(found)).otherwise(F.regexp_replace(stem, "^stations_", ""))


def station_key(tech: Column, ssp: Column, region: Column, index: Column) -> Column:
    """As in S126_France_00012."""
    return F.format_string("%s%s_%s_%05d", F.upper(F.substring(tech, 1, 1)), F.substring(ssp, -3, 3), region, index)


def activation_bucket(year: Column) -> Column:
    """The target year from which a station counts."""
    return F.when(year <= 2030, 2030).when(year <= 2040, 2040).otherwise(2050)


def quality_status(value: Column, covered: Column) -> Column:
    """nodata where the source doesn't cover the station, else bad or ok."""
    return F.when(~covered, "nodata").when(zero_or_missing(value), "bad").otherwise("ok")


def is_sea(lsm: Column, wind: Column | None = None) -> Column:
    """below half land; an unknown share isn't sea.  F26b: with wind, where
    the land-only field is missing."""
    if wind is not None:
        return known(wind).isNull()
    return F.coalesce(known(lsm) < 0.5, F.lit(False))


def arrow(now: Column, then: Column, margin: float) -> Column:
    """F19."""
    return F.when(now > then + margin, "↑").when(now < then - margin, "↓").otherwise("")


def deployment_multiplier(ssp: Column, year: Column) -> Column:
    """F12."""
    return lookup(year, K.DEPLOY_YEAR_FACTOR) * lookup(ssp, K.DEPLOY_SSP_FACTOR)


def hazard_multiplier(ssp: Column, year: Column) -> Column:
    """F12b."""
    return 1.0 + (lookup(ssp, K.HAZARD_SSP_FACTOR) - 1.0) * lookup(year, K.YEAR_PROGRESS)


def cf_multiplier(tech: Column, ssp: Column, year: Column) -> Column:
    """F12c."""
    effect = F.when(tech == "solar", lookup(ssp, K.CF_SSP_EFFECT["solar"])).otherwise(lookup(ssp, K.CF_SSP_EFFECT["wind"]))
    return 1.0 + effect * lookup(year, K.YEAR_PROGRESS)


def season(tech: Column, month: Column) -> Column:
    """the month's share of the mean capacity factor."""
    turn = F.lit(2.0) * F.pi() / 12.0
    return F.when(tech == "solar", 1.0 + K.SUN_SEASON * F.sin((month - K.SUN_SEASON_FROM) * turn)).otherwise(1.0 + K.WIND_SEASON * F.cos((month - K.WIND_SEASON_FROM) * turn))


def days_in_month(month: Column) -> Column:
    """F13, of a year without a leap day."""
    return F.element_at(F.array(*map(F.lit, K.DAYS_IN_MONTH)), month)


def annual_generation(capacity_mw: Column, cf: Column) -> Column:
    """F14, MWh."""
    return capacity_mw * K.HOURS * cf
