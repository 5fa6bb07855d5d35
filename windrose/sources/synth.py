"""SRC13: invented studies of any size, with the shape of real ones.

Every draw is a function of the seed, its name and the row's keys, so a table is
the same however its rows are partitioned and whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import annual_generation, cf_multiplier, clip, days_in_month, deployment_multiplier, hazard_multiplier, lookup, season, sigmoid
from ..operators import generation, risk, scenario


class Draws:
    """Random columns from a seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, name: str, *keys: str, low: float = 0.0, high: float = 1.0) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(name), *keys), 11)
        return low + (high - low) * ((bits + 0.5) / float(1 << 53))

    def normal(self, name: str, *keys: str) -> Column:
        u, v = self.uniform(name + "/radius", *keys), self.uniform(name + "/angle", *keys)
        return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)

    def lognormal(self, name: str, sigma: float, *keys: str, median: float = 1.0) -> Column:
        return median * F.exp(sigma * self.normal(name, *keys))

    def poisson(self, name: str, mean: Column, *keys: str) -> Column:
        """By the inverse of the distribution function."""
        u = self.uniform(name, *keys)
        most = (mean + 10 * F.sqrt(mean) + 20).cast("int")
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.lit(0).alias("k"))
        step = lambda s, i: F.when(s.total >= u, s).otherwise(F.struct((s.p * mean / i).alias("p"), (s.total + s.p * mean / i).alias("total"), i.cast("int").alias("k")))
        return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s.k)


def _dimension(spark: SparkSession, name: str, values: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def country_base(spark: SparkSession, seed: int, countries: list[str] | None = None) -> DataFrame:
    """Features of countries."""
    r, df = Draws(seed), _dimension(spark, "country", countries or K.COUNTRIES, "string")
    df = df.withColumns({"lat_center": r.uniform("lat", "country", low=K.LAT_RANGE[0], high=K.LAT_RANGE[1]), "lon_center": r.uniform("lon", "country", low=K.LON_RANGE[0], high=K.LON_RANGE[1])})
    far = F.abs("lat_center")
    near = lambda name, mean, spread: clip(mean + spread[0] * r.normal(name, "country"), *spread[1:])
    return df.withColumns(
        {
            "system_scale_index": F.coalesce(lookup(F.col("country"), K.SYSTEM_SCALE), F.lit(1.0)) * r.lognormal("scale", K.SCALE_SIGMA, "country"),
            "solar_resource_index": near("sun", 1.0 + F.greatest(K.SUN_TROPIC - far, F.lit(0.0)) / K.SUN_PER_DEGREE, K.SUN_INDEX),
            "wind_resource_index": near("wind", 1.0 + far / K.WIND_PER_DEGREE, K.WIND_INDEX),
            "extreme_weather_index": near("weather", 1.0 + far / K.WEATHER_PER_DEGREE, K.WEATHER_INDEX),
        }
    )


def station_catalog(base: DataFrame, seed: int) -> DataFrame:
    """SRC13b, J21: sites by country, deployment, year and technology, at least two."""
    spark, r = base.sparkSession, Draws(seed)
    dims = _dimension(spark, "deploy_ssp", K.SSPS, "string").crossJoin(_dimension(spark, "target_year", K.YEARS, "int")).crossJoin(_dimension(spark, "technology", K.TECHS, "string"))
    sun = F.col("technology") == "solar"
    group = ["country", "deploy_ssp", "target_year", "technology"]
    cells = base.crossJoin(F.broadcast(dims)).withColumn("resource_index", F.when(sun, F.col("solar_resource_index")).otherwise(F.col("wind_resource_index")))
    mean = F.floor(clip(F.col("system_scale_index") * deployment_multiplier(F.col("deploy_ssp"), F.col("target_year")) * lookup(F.col("technology"), K.SITES_PER_SCALE), *K.SITES_RANGE)).cast("double")
    sites = cells.withColumn("n", F.greatest(r.poisson("sites", mean, *group), F.lit(K.SITES_LEAST))).withColumn("site", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = [*group, "site"]
    drawn = lambda t: clip(K.BASE_CF[t][0] * F.col("resource_index") + K.BASE_CF[t][1] * r.normal("cf", *key), *K.BASE_CF[t][2:])
    factor = F.when(sun, drawn("solar")).otherwise(drawn("wind"))
    return sites.select(
        F.format_string("S%016x", F.xxhash64(*key)).alias("station_id"), *group, (F.col("lat_center") + K.SITE_LAT_SPREAD * r.normal("dlat", *key)).alias("lat"), (F.col("lon_center") + K.SITE_LON_SPREAD * r.normal("dlon", *key)).alias("lon"),
        (lookup(F.col("technology"), K.CAPACITY_MEDIAN_MW) * r.lognormal("capacity", K.CAPACITY_SIGMA, *key)).alias("capacity_mw"), factor.alias("base_capacity_factor"), "resource_index",
        clip(F.col("extreme_weather_index") * r.lognormal("local", K.LOCAL_WEATHER[0], *key), *K.LOCAL_WEATHER[1:]).alias("station_extreme_weather_index"),
    )


def station_annual(catalog: DataFrame, seed: int) -> DataFrame:
    """Factors and generation of each site under each climate."""
    r, climate = Draws(seed), _dimension(catalog.sparkSession, "climate_ssp", K.SSPS, "string")
    cf = F.col("base_capacity_factor") * cf_multiplier(F.col("technology"), F.col("climate_ssp"), F.col("target_year")) * r.lognormal("year", K.YEAR_CF[0], "station_id", "climate_ssp")
    out = catalog.crossJoin(F.broadcast(climate)).withColumn("annual_capacity_factor", clip(cf, *K.YEAR_CF[1:]))
    return out.select(*risk.STATION_KEYS, "capacity_mw", "annual_capacity_factor", annual_generation(F.col("capacity_mw"), F.col("annual_capacity_factor")).alias("annual_generation_mwh"))


def station_monthly(annual: DataFrame, seed: int) -> DataFrame:
    """the same by month."""
    r = Draws(seed)
    months = annual.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    cf = clip(F.col("annual_capacity_factor") * season(F.col("technology"), F.col("month")) * r.lognormal("month", K.MONTH_CF[0], "station_id", "climate_ssp", "month"), *K.MONTH_CF[1:])
    out = months.withColumn("monthly_capacity_factor", cf)
    return out.select(*risk.STATION_KEYS, "month", "capacity_mw", "monthly_capacity_factor", (F.col("capacity_mw") * days_in_month(F.col("month")) * 24 * F.col("monthly_capacity_factor")).alias("monthly_generation_mwh"))


def country_annual(annual: DataFrame) -> DataFrame:
    """A4 over the sites."""
    named = annual.withColumnsRenamed({"annual_capacity_factor": "capacity_factor", "annual_generation_mwh": "generation_mwh"})
    out = generation.weighted_cf(named, risk.COUNTRY_KEYS[:-1], K.HOURS)
    return out.withColumnsRenamed({"generation_mwh": "annual_generation_mwh", "weighted_cf": "capacity_weighted_cf"})


def event_hazard(base: DataFrame, seed: int) -> DataFrame:
    """Hazards by country, climate, year, technology and event."""
    spark, r = base.sparkSession, Draws(seed)
    events = spark.createDataFrame([(t, e) for t, own in K.EVENTS.items() for e in own], "technology string, event_type string")
    dims = events.crossJoin(_dimension(spark, "climate_ssp", K.SSPS, "string")).crossJoin(_dimension(spark, "target_year", K.YEARS, "int"))
    key = ["country", "climate_ssp", "target_year", "event_type"]
    scale = F.col("extreme_weather_index") * hazard_multiplier(F.col("climate_ssp"), F.col("target_year"))
    df = base.crossJoin(F.broadcast(dims)).withColumn("event_frequency_hours_per_year", clip(lookup(F.col("event_type"), K.EVENT_HOURS) * scale * r.lognormal("hours", K.EVENT_HOURS_SPREAD[0], *key), *K.EVENT_HOURS_SPREAD[1:]))
    hours = F.col("event_frequency_hours_per_year")
    return df.select(
        "country", "climate_ssp", "target_year", "technology", "event_type", hours, clip(hours / K.HOURS_PER_EVENT + K.DURATION_SPREAD[0] * r.normal("duration", *key), *K.DURATION_SPREAD[1:]).alias("mean_event_duration_hours"),
        clip(lookup(F.col("event_type"), K.EVENT_INTENSITY) * scale * r.lognormal("intensity", K.INTENSITY_SPREAD[0], *key), *K.INTENSITY_SPREAD[1:]).alias("event_intensity_index"),
        (F.col("system_scale_index") * K.AREA_PER_SCALE * sigmoid(hours / K.AREA_HOURS) * r.lognormal("area", K.AREA_SIGMA, *key)).alias("affected_area_km2"),
    )


def study(spark: SparkSession, seed: int = 42, countries: list[str] | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """All tables of a study.  keep: what those that build on a table use for it,
    such as the table written and read again; as it stands, its plan."""
    r, key = Draws(seed), ("station_id", "climate_ssp", "event_type")
    noise = lambda name, sigma: r.lognormal(name, sigma, *key)
    near = r.uniform("event", *key, low=K.EVENT_CF_RANGE[0], high=K.EVENT_CF_RANGE[1])
    steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
        "country_base": lambda t: country_base(spark, seed, countries),
        "station_catalog": lambda t: station_catalog(t["country_base"], seed),
        "station_annual": lambda t: station_annual(t["station_catalog"], seed),
        "station_monthly": lambda t: station_monthly(t["station_annual"], seed),
        "country_annual": lambda t: country_annual(t["station_annual"]),
        "country_event_hazard": lambda t: event_hazard(t["country_base"], seed),
        "station_event_exposure": lambda t: risk.exposures(t["station_catalog"], t["station_annual"], t["country_event_hazard"], noise("local", K.EXPOSURE_SIGMA), noise("share", K.EXPOSED_GENERATION_SIGMA)),
        "country_event_exposure": lambda t: risk.country_exposure(t["station_event_exposure"]),
        "station_event_losses": lambda t: risk.losses(t["station_event_exposure"], t["station_annual"], noise("harm", K.VULNERABILITY_SIGMA), near),
        "country_event_losses": lambda t: risk.country_losses(t["station_event_losses"]),
        "risk_matrix": lambda t: risk.risk_matrix(t["country_event_losses"]),
        "risk_decomposition": lambda t: scenario.decomposition(t["risk_matrix"], ["country", "technology", "target_year"], "loss_mwh"),
        "country_risk_profile": lambda t: risk.country_profile(t["risk_matrix"]),
        "country_event_contribution": lambda t: risk.event_contribution(t["country_event_losses"]),
        "country_technology_vulnerability": lambda t: risk.technology_vulnerability(t["country_event_losses"]),
    }
    tables: dict[str, DataFrame] = {}
    for name, make in steps.items():
        tables[name] = keep(name, make(tables))
    return tables
