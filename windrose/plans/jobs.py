"""Whole runs from files to tables, as the command line offers them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import ssp_code, ssp_from_path, station_key
from ..operators import coverage, generation, spatial
from ..sources import readers, sinks, synth

log = logging.getLogger(__name__)

FILE_KEYS = ["technology", "region", "climate_ssp"]
COUNTRY_KEYS = ["technology", "deploy_ssp", "climate_ssp", "target_year"]


def located(stations: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Stations with their country, looked up once for each place."""
    if edges is None:
        return stations
    places = stations.select(F.struct("station_lon", "station_lat").alias("place"), F.col("station_lon").alias("lon"), F.col("station_lat").alias("lat")).distinct()
    named = spatial.in_polygons(places, edges, "place").select(F.col("place.station_lon").alias("station_lon"), F.col("place.station_lat").alias("station_lat"), F.col("polygon").alias("country"))
    return stations.drop("country").join(named, ["station_lon", "station_lat"], "left")


def station_tables(power: DataFrame, stations: DataFrame, years: Sequence[int] = K.YEARS, ssps: Sequence[str] = K.SSPS, dt_hours: float = 3.0, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """``station_annual, station_monthly, country_annual``: deployment and climate
    agree in these tables, by the way they are made (T19).  power is scanned once, for
    sums and steps by month, which those by year follow from.  keep: writes a table and
    reads it again, so that the annual table is made once."""
    chosen = power.filter(F.col("year").isin(list(years)) & F.col("climate_ssp").isin(list(ssps)))
    monthly = generation.power_figures(chosen, ["year", "month"], FILE_KEYS)
    figures = {"station_monthly": monthly, "station_annual": generation.yearly_figures(*monthly, FILE_KEYS)}
    out = {}
    for name, by, word in (("station_annual", ("year",), "annual"), ("station_monthly", ("year", "month"), "monthly")):
        df = generation.with_output_rounding(generation.from_figures(*figures[name], stations, by, FILE_KEYS, dt_hours))
        out[name] = keep(name, df.select(
            station_key(F.col("technology"), F.col("climate_ssp"), F.col("region"), F.col("station_idx")).alias("station_id"), "country", "technology", F.col("climate_ssp").alias("deploy_ssp"), "climate_ssp",
            F.col("year").alias("target_year"), *(["month"] if "month" in by else []), "capacity_mw", F.col("capacity_factor").alias(f"{word}_capacity_factor"), F.col("generation_mwh").alias(f"{word}_generation_mwh"),
        ))
    plain = out["station_annual"].withColumnsRenamed({"annual_capacity_factor": "capacity_factor", "annual_generation_mwh": "generation_mwh"})
    out["country_annual"] = keep("country_annual", generation.country_annual(plain, COUNTRY_KEYS).withColumnRenamed("generation_mwh", "annual_generation_mwh"))
    return out


def prepare(spark: SparkSession, power: str, stations: str, out: str, polygons: str | None = None, years: Sequence[int] = K.YEARS, ssps: Sequence[str] = K.SSPS, dt_hours: float = 3.0) -> dict[str, int]:
    """From power and station tables to the three result tables, each written as it is
    made; their row counts."""
    edges = spark.read.parquet(polygons) if polygons else None
    counts: dict[str, int] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        counts[name] = sinks.write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    tables = station_tables(readers.power(spark, power), located(spark.read.parquet(stations), edges), years, ssps, dt_hours, keep)
    rows = {name: counts[name] for name in tables}
    written = spark.read.parquet(f"{out}/country_annual").withColumnRenamed("annual_generation_mwh", "generation_mwh")
    for r in generation.check_table(written, ["technology", "climate_ssp", "target_year"]).orderBy("technology", "climate_ssp", "target_year").collect():  # a row for each scenario and year
        log.info("%s %s %s: %s countries, %.3f GW, %.3f TWh, mean factor %.4f", *r)
    return rows


def study(spark: SparkSession, out: str, seed: int = 42, countries: Sequence[str] | None = None) -> dict[str, int]:
    """An invented study: every table is written and read again by those after it."""
    rows: dict[str, int] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        rows[name] = sinks.write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    synth.study(spark, seed, list(countries) if countries else None, keep)
    sinks.metadata(spark, f"{out}/metadata", seed, rows)
    return rows


def station_coverage(spark: SparkSession, stations: str, out: str, raster: str | None = None, ssp: str | None = None, domain: tuple[float, float, float, float] | None = None, cell: float = 0.1) -> dict[str, int]:
    """Coverage of sites and capacity by the rectangles (and the rotated domain), in
    all and by macro-region where a region raster (row, col, region_id; rows from 90
    degrees north, columns from 180 degrees west) is given."""
    from ..functions.geo import in_rotated_domain, to_180

    lon, lat = F.col("lon"), F.col("lat")
    inside = spatial.in_any_area(lon, lat)
    if domain:
        inside = inside | in_rotated_domain(lon, lat, domain)
    code = ssp_code(F.lit(ssp)) if ssp else ssp_from_path(F.lit(stations))
    sites = readers.stations(spark, stations).withColumns({"inside": inside, "ssp": code})
    reports = {"coverage": sinks.coverage_report(coverage.coverage_with_total(sites, "type", ["ssp", "year"]), "type")}
    if raster:
        n_rows, n_cols = round(180 / cell), round(360 / cell)
        at = sites.withColumns({"row": spatial.raster_index(90.0 - lat, 0.0, cell, n_rows), "col": spatial.raster_index(to_180(lon) + 180.0, 0.0, cell, n_cols)})
        found = spatial.raster_lookup(at, spark.read.parquet(raster), "region_id").filter("region_id > 0")
        by_region = coverage.coverage_with_total(found, "region_id", ["ssp", "year"])
        names = readers.region_names(spark).select(F.col("region_id").cast("string").alias("region_id"), "region_name")
        years = sites.select("ssp", "year").distinct()
        every = years.crossJoin(F.broadcast(names.select("region_id").union(spark.createDataFrame([("ALL",)], "region_id string"))))  # 21 rows
        dense = coverage.on_keys(every, by_region, ["ssp", "year", "region_id"], dict.fromkeys([c for c in by_region.columns if c not in ("ssp", "year", "region_id")], 0))
        reports["coverage_by_region"] = sinks.coverage_report(dense.join(names, "region_id", "left"), "region_id")
    return {name: sinks.write_table(df, f"{out}/{name}", csv=True) for name, df in reports.items()}
