"""Every query of the library over the driver's tables, with DuckDB SQL.

docstring.  Doubles are rounded on both sides, so that the order of additions
doesn't show.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo, scalar
from ..operators import coverage, generation, quality, ranking, rings, risk, scenario, spatial, stats
from ..sources import readers, scratch, sinks, synth
from . import views
from .oracle import ORACLE_SQL

YEARS = [1996, 1998, 2000]
BOTH = ["technology", "deploy_ssp", "climate_ssp"]
DOMAIN = (-40.0, 35.0, -30.0, 40.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _annual(spark: SparkSession, sf_dir: str, keys=generation.FILE_KEYS, by=("year",)) -> DataFrame:
    return generation.station_period(views.power(spark, sf_dir), views.stations(spark, sf_dir), by, keys)


def _country(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["technology", "climate_ssp", "year"]
    return generation.country_annual(_annual(spark, sf_dir), keys)


def q01_station_annual_cf(spark, sf_dir):
    """A1 A2 P8 T1-T4, the flagship: station-year capacity factor and generation."""
    return rounded(_annual(spark, sf_dir))


def q02_station_monthly_cf(spark, sf_dir):
    """A1b."""
    return rounded(_annual(spark, sf_dir, by=("year", "month")))


def q03_country_annual(spark, sf_dir):
    """A3 T8 T14."""
    return rounded(_country(spark, sf_dir))


def q03b_check_table(spark, sf_dir):
    """A3b A19."""
    return rounded(generation.check_table(_country(spark, sf_dir), ["technology", "climate_ssp"]))


def q04_capacity_weighted_cf(spark, sf_dir):
    """A4 A5 A5b."""
    df, keys = _annual(spark, sf_dir), ["technology", "climate_ssp", "year"]
    mean = generation.weighted_cf(df, keys).withColumnRenamed("weighted_cf", "mean_weighted_cf")
    return rounded(mean.join(generation.weighted_cf(df, keys, generation.HOURS).select(*keys, F.col("weighted_cf").alias("hours_cf")), keys))


def q04b_monthly_weighted_cf(spark, sf_dir):
    """A5c A5d."""
    return rounded(generation.weighted_cf(_annual(spark, sf_dir, by=("year", "month")), ["technology", "climate_ssp", "month"], scale=100.0))


def q04c_generation_totals(spark, sf_dir):
    """A6 P13 T-9."""
    return rounded(ranking.ordered(generation.totals(_annual(spark, sf_dir), ["technology", "climate_ssp", "year"], "generation_mwh", 1e6), "year", "technology", False))


def q05_coherent_vs_fixed_fleet(spark, sf_dir):
    """P3 P4 A5e T19."""
    df = _annual(spark, sf_dir, BOTH)
    rows = generation.coherent(df).withColumn("fleet", F.lit("coherent")).unionByName(generation.fixed_fleet(df).withColumn("fleet", F.lit("fixed")))
    return rounded(generation.weighted_cf(rows, ["fleet", "technology", "climate_ssp", "year"]))


def q06_coverage_rollup(spark, sf_dir):
    """A7 A7c A8 J3 T7 F17."""
    s = views.sites(spark, sf_dir)
    s = s.withColumn("inside", spatial.in_any_area(F.col("lon"), F.col("lat"), [b[1:] for b in views.BOXES]))
    return rounded(coverage.coverage_with_total(s, "technology", total="all"))


def q06b_coverage_by_group_total(spark, sf_dir):
    """A total in each group, none across."""
    s = views.sites(spark, sf_dir).withColumn("inside", spatial.in_any_area(F.col("lon"), F.col("lat")))
    return rounded(coverage.coverage_with_total(s, "nation_key", ["technology"]))


def q06c_dense_regions(spark, sf_dir):
    """A8b A8d J18: every macro-region, zeros kept."""
    s = spatial.raster_lookup(_located(views.sites(spark, sf_dir)), views.cells(spark), "region_id")
    s = s.withColumn("inside", spatial.in_any_area(F.col("lon"), F.col("lat")))
    regions = spark.createDataFrame(list(enumerate(K.MACRO_REGIONS, 1)), "region_id int, region_name string")
    return rounded(coverage.dense_regions(coverage.coverage(s, ["region_id"]), regions))


def q07_first_match_region(spark, sf_dir):
    """Areas from a table."""
    return spatial.first_area_join(views.sites(spark, sf_dir), views.boxes(spark), "site_id")


def q07b_first_match_constant(spark, sf_dir):
    """J1 SRC14: the built-in rectangles as one expression."""
    return views.sites(spark, sf_dir).select("site_id", spatial.first_area(F.col("lon"), F.col("lat")).alias("area"))


def q08_rotated_domain(spark, sf_dir):
    """J4 F8."""
    lon, lat = F.col("lon"), F.col("lat")
    rlon, rlat = geo.to_rotated(lon, lat)
    return rounded(views.sites(spark, sf_dir).select("site_id", rlon.alias("rlon"), rlat.alias("rlat"), geo.in_rotated_domain(lon, lat, DOMAIN).alias("inside")), 5)


def q09_point_in_polygon(spark, sf_dir):
    """J5 J5b T9."""
    found = spatial.polygons_at(views.sites(spark, sf_dir).select("site_id", "lon", "lat"), views.polygons(spark))
    return found.select("site_id", "covers", F.coalesce("contains", F.lit(spatial.OUTSIDE)).alias("contains"))


def q09b_named_polygons(spark, sf_dir):
    """J20 SRC5b: some polygons under other names and in another order."""
    edges = readers.named_polygons(views.polygons(spark), {"kite": "dragon"}, ["inner", "dragon"])
    return spatial.in_polygons(views.sites(spark, sf_dir).select("site_id", "lon", "lat"), edges, "site_id").select("site_id", "polygon")


def _located(s: DataFrame, how: str = "floor", drop: bool = False) -> DataFrame:
    return s.withColumns({"row": spatial.raster_index(90.0 - F.col("lat"), 0.0, 10.0, views.N_ROWS, how, drop), "col": spatial.raster_index(geo.to_360(F.col("lon")), 0.0, 10.0, views.N_COLS, how, drop)})


def q10_raster_lookup(spark, sf_dir):
    """Floor and rint, clipped to the edge."""
    s, c = views.sites(spark, sf_dir).select("site_id", "lon", "lat"), views.cells(spark)
    a = spatial.raster_lookup(_located(s), c, "region_id").select("site_id", F.col("region_id").alias("floor_region"))
    b = spatial.raster_lookup(_located(s, "rint"), c, "region_id").select("site_id", F.col("region_id").alias("rint_region"))
    return a.join(b, "site_id")


def q11_nearest_axis(spark, sf_dir):
    """Periodic and plain longitude."""
    lon, lat = F.col("lon"), F.col("lat")
    return views.sites(spark, sf_dir).select(
        "site_id", spatial.nearest_on_axis(lat, views.LAT_AXIS).alias("ilat"), spatial.nearest_on_axis(geo.to_360(lon), views.LON_AXIS, True).alias("ilon"), spatial.nearest_on_axis(geo.to_360(lon), views.LON_AXIS).alias("ilon_plain")
    )


def q11b_nearest_point(spark, sf_dir):
    """Each site's nearest station, however far, and whether it is nearer than 0.3 degrees."""
    found = spatial.nearest_any(views.sites(spark, sf_dir), table_places(spark, sf_dir), "site_id")
    return rounded(found.withColumn("near", F.col("distance") < 0.3))


def table_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(key.alias("cell_id"), ((key * 911 % 3600) / F.lit(10.0)).alias("lon"), ((key * 577 % 1500) / F.lit(10.0) - 65.0).alias("lat"))


def q11c_fill_background(spark, sf_dir):
    """Background cells under sites take the nearest region."""
    c = views.cells(spark)
    wanted = _located(views.sites(spark, sf_dir)).select("row", "col").distinct().join(c.filter("region_id = 0").select("row", "col"), ["row", "col"])
    return spatial.fill_background(c, wanted, "region_id")


def q12_grid_occupancy(spark, sf_dir):
    """A10 A10c U5."""
    s = _located(views.sites(spark, sf_dir), drop=True).withColumn("inside", F.col("capacity_gw") > 0)
    return rounded(spatial.occupancy(s))


def q12b_grid_by_region(spark, sf_dir):
    """A10b A10c A10d A7d."""
    s = _located(views.sites(spark, sf_dir), drop=True).withColumn("inside", F.col("capacity_gw") > 5)
    return rounded(spatial.grid_by_region(views.cells(spark), spatial.occupancy(s)))


def q13_raster_mode(spark, sf_dir):
    """Regions of the cells under sites, in blocks of five; the last column block is
    partial and cut off."""
    found = _located(views.sites(spark, sf_dir)).groupBy("row", "col").agg((F.sum("site_id") % 5).cast("int").alias("region_id"))
    return spatial.raster_mode(found, 5, views.N_ROWS, views.N_COLS)


def q13b_region_rings(spark, sf_dir):
    """Rings around the cells under sites by region, holes told apart."""
    found = _located(views.sites(spark, sf_dir)).groupBy("row", "col").agg((F.sum("site_id") % 3).cast("int").alias("region_id"))
    return rings.region_rings(found, "region_id").withColumnRenamed("value", "region_id")


def q14_zero_nan_quality(spark, sf_dir):
    """A11 F24 P11."""
    df = views.power(spark, sf_dir)
    return rounded(quality.status_counts(df, ["technology", "climate_ssp"], "power_gw", F.col("deploy_ssp") != "ssp585"))


def q14b_agreement(spark, sf_dir):
    """A12b."""
    df = views.table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("b"))
    return rounded(quality.agreement(df, ["l_returnflag"], "a", "b"))


def q14c_denominators(spark, sf_dir):
    """A12."""
    df = views.power(spark, sf_dir)
    return rounded(quality.by_denominator(df, "power_gw", "climate_ssp", {"national": ["ssp126"], "continental": ["ssp245", "ssp585"], "all": K.SSPS}))


def q14d_missing_by_surface(spark, sf_dir):
    """A13 A13c A11c F26."""
    df = views.power(spark, sf_dir).withColumn("sea", scalar.is_sea((F.col("station_idx") % 7) / F.lit(6.0)))
    return rounded(quality.missing_by_surface(df, ["technology"], "power_gw", "sea"))


def q15_edge_bands(spark, sf_dir):
    """Grids of the sites' capacity by nation, empty where it has none but
    within 30 degrees of the equator, and the widths in degrees."""
    s = _located(views.sites(spark, sf_dir).filter(F.abs("lat") < 30), drop=True).groupBy(F.col("nation_key").alias("grid"), "row", "col").agg(F.sum("capacity_gw").alias("value"))
    grids = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grid"))
    whole = spatial.mesh(grids, views.cells(spark).select("row", "col")).join(s, ["grid", "row", "col"], "left")
    axis = lambda n, step: spatial.mesh(grids, spark.range(n).select(F.col("id").cast("int").alias("index"))).select("grid", "index", (85.0 - step * F.col("index") / (1 + F.col("grid") % 2)).alias("value"))
    return rounded(spatial.bands_in_degrees(spatial.edge_bands(whole, ["grid"]), axis(views.N_ROWS, 10.0), axis(views.N_COLS, -5.0), ["grid"]))


def q16_rms_combine(spark, sf_dir):
    """A14 A14b."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("u"), F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("v"))
    mean = generation.time_mean(e, ["user_id"], "u").withColumnRenamed("u", "mean_u")
    return rounded(generation.rms_wind(e, ["user_id"]).join(mean, "user_id"))


def q17_percentiles(spark, sf_dir):
    """A15 A15b."""
    return rounded(stats.quantiles(_annual(spark, sf_dir), ["technology", "climate_ssp"], "capacity_factor", (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)))


def q18_variation(spark, sf_dir):
    """A16 P9."""
    return rounded(stats.variation(_annual(spark, sf_dir, by=("year", "month")), ["station_idx", "technology"], "capacity_factor"))


def q18b_correlation(spark, sf_dir):
    """A17."""
    monthly = generation.totals(_annual(spark, sf_dir, by=("year", "month")), ["country", "technology", "year", "month"], "generation_mwh")
    return rounded(stats.pair_correlation(monthly, ["country"], ["year", "month"], "technology", "solar", "wind", "generation_mwh"), 5)


def q19_kde(spark, sf_dir):
    """A21."""
    return rounded(stats.density(_annual(spark, sf_dir), ["technology", "climate_ssp"], "capacity_factor", 0.0, 0.02))


def q19d_nested_violins(spark, sf_dir):
    """Years within a scenario at one scale, scenarios with a sparse year left out."""
    rows = _annual(spark, sf_dir).filter("technology = 'solar' OR climate_ssp <> 'ssp245' OR station_idx < 3")
    return rounded(stats.nested_violins(rows, ["technology", "climate_ssp"], "year", YEARS, "capacity_factor", 0.0, 0.02))


def q19c_kde_own_peak(spark, sf_dir):
    """From two values on, as shares of the own peak."""
    keys = ["country", "technology"]
    return rounded(stats.to_own_peak(rounded(stats.density(_country(spark, sf_dir), keys, "mean_cf", 0.0, 0.02, least=2)), keys))


def q19b_kde_log(spark, sf_dir):
    """A21b F22."""
    df = generation.positive(_annual(spark, sf_dir), "generation_mwh")
    return rounded(stats.density(df, ["technology"], "generation_mwh", 3.0, 7.0, 20, log=True))


def q20_linear_trend(spark, sf_dir):
    """A22."""
    yearly = generation.totals(_annual(spark, sf_dir), ["technology", "climate_ssp", "year"], "generation_mwh", 1e6)
    line = stats.trend(yearly, ["technology", "climate_ssp"], "year", "generation_mwh")
    log = stats.trend(yearly, ["technology", "climate_ssp"], "year", "generation_mwh", log=True).select("technology", "climate_ssp", F.col("slope").alias("log_slope"))
    return rounded(line.join(log, ["technology", "climate_ssp"]), 5)


def q20b_median_trend(spark, sf_dir):
    """Lines through the medians of scenarios and years, and of one year."""
    df = generation.positive(_annual(spark, sf_dir), "capacity_factor").filter(F.col("year").isin(YEARS))
    fit = lambda rows, name, log=False: stats.median_trend(rows, ["technology"], "climate_ssp", K.SSPS, ["year"], "capacity_factor", log).select("technology", F.col("slope").alias(f"{name}slope"), F.col("intercept").alias(f"{name}intercept"), F.col("n").alias(f"{name}n"))
    return rounded(fit(df, "").join(fit(df, "log_", True), "technology").join(fit(df.filter(F.col("year") == YEARS[-1]), "last_"), "technology"))


def q21_pivot_change_vs_base(spark, sf_dir):
    """A23 W3 W3b W3c T6."""
    wide = scenario.pivoted(_country(spark, sf_dir), ["country", "technology", "climate_ssp"], "year", YEARS, "mean_cf", "y")
    return rounded(wide.withColumn("change_pct", scenario.percent_change(F.col("y2000"), F.col("y1996"))))


def q21b_anomaly(spark, sf_dir):
    """W3b."""
    return rounded(scenario.change_vs_base(_country(spark, sf_dir).select("country", "technology", "climate_ssp", "year", "mean_cf"), ["country", "technology", "climate_ssp"], "mean_cf", 1996))


def q22_period_increments(spark, sf_dir):
    """W4 W4b F10."""
    keys = ["country", "technology", "climate_ssp"]
    df = generation.totals(_country(spark, sf_dir), [*keys, "year"], "generation_mwh", 1e6)
    out = scenario.increments(df, keys, "generation_mwh", YEARS)
    share = scenario.increments(df, keys, "generation_mwh", YEARS, relative=True).select(*keys, F.col("total").alias("relative_total"))
    return rounded(out.join(share, keys))


def q22b_relative_to_member(spark, sf_dir):
    """W5."""
    df = generation.totals(_country(spark, sf_dir).filter("year = 1998"), ["country", "climate_ssp"], "generation_mwh", 1e6)
    return rounded(scenario.relative_to_member(df, ["country"], "climate_ssp", "ssp126", "generation_mwh"))


def q22c_covered_increments(spark, sf_dir):
    """W4b T-4 F19 F19b."""
    s = views.sites(spark, sf_dir).withColumns({"year": F.element_at(F.array(*map(F.lit, K.YEARS)), (F.col("site_id") % 3 + 1).cast("int")), "inside": spatial.in_any_area(F.col("lon"), F.col("lat"))})
    df = coverage.coverage(s, ["nation_key", "year"])
    out = scenario.covered_increments(df, ["nation_key"], "cap_inside", "cap_total", K.YEARS)
    return rounded(ranking.labelled(out.withColumn("name", F.format_string("n%d", "nation_key")), "name", "coverage", "seg_2030", 0.02, 0.2))


def q23_topk_bottomk(spark, sf_dir):
    """T-1 T-2 U2."""
    df = generation.totals(_country(spark, sf_dir).filter("year = 1998"), ["country"], "generation_mwh", 1e6)
    return rounded(ranking.extremes(df, "generation_mwh", 8, "country"))


def q23b_row_mean_order(spark, sf_dir):
    """T-3 T-6 T-7 A23: countries by the mean of their scenarios."""
    wide = scenario.pivoted(_country(spark, sf_dir), ["country"], "climate_ssp", K.SSPS, "mean_cf", "")
    return rounded(ranking.top(wide.withColumn("score", ranking.row_mean(*K.SSPS)), "score", 12, "country"))


def q24_quadrants(spark, sf_dir):
    """W7 W8 P7."""
    df = generation.positive(_annual(spark, sf_dir), "capacity_mw", "capacity_factor")
    return rounded(scenario.quadrants(df, ["climate_ssp"], "capacity_mw", "capacity_factor", "generation_mwh"))


def q25_latitude_bins(spark, sf_dir):
    """Ten-degree bins; empty ones stay."""
    bins = spark.range(1, 19).select(F.col("id").cast("int").alias("bin"))
    return rounded(stats.fixed_bins(views.sites(spark, sf_dir), bins, "lat", -90.0, 10.0, "capacity_gw"), 8)


def q25b_decile_bins(spark, sf_dir):
    """S7 A15b."""
    return rounded(stats.decile_bins(views.sites(spark, sf_dir), "capacity_gw", "lat"))


def _risk_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exposure and losses by event, from events summed by user and Q01's totals."""
    annual = _annual(spark, sf_dir, BOTH).select(
        F.col("station_idx").cast("string").alias("station_id"), "country", "technology", "deploy_ssp", "climate_ssp", F.col("year").alias("target_year"), "capacity_mw",
        F.col("capacity_factor").alias("annual_capacity_factor"), F.col("generation_mwh").alias("annual_generation_mwh"),
    )
    kind = F.element_at(F.array(*map(F.lit, [e for own in K.EVENTS.values() for e in own])), (F.col("event_id") % 5 + 1).cast("int"))
    hours = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("station_id"), kind.alias("event_type")).agg(F.sum("value").alias("exposed_hours"), F.avg("value").alias("event_intensity_index"))
    met = annual.join(hours, "station_id")
    exposure = met.select(
        *risk.STATION_KEYS, "event_type", "capacity_mw", "exposed_hours", (F.col("capacity_mw") * F.col("exposed_hours")).alias("exposed_capacity_mw_hours"),
        (F.col("annual_generation_mwh") * F.col("exposed_hours") / K.HOURS).alias("exposed_generation_mwh"), "event_intensity_index",
    )
    return exposure, risk.losses(exposure.dropDuplicates(["station_id", "technology", "deploy_ssp", "climate_ssp", "target_year", "event_type"]), annual_by_key(annual))


def annual_by_key(annual: DataFrame) -> DataFrame:
    """One row for each station and pair of scenarios, as in a catalog of sites."""
    return annual.groupBy("station_id", "deploy_ssp", "climate_ssp").agg(F.sum("annual_generation_mwh").alias("annual_generation_mwh"), F.avg("annual_capacity_factor").alias("annual_capacity_factor"))


def q26_exposure(spark, sf_dir):
    """A24 J14."""
    return rounded(rounded(risk.country_exposure(_risk_tables(spark, sf_dir)[0])).withColumn("exposed_capacity_mw_hours", F.round("exposed_capacity_mw_hours", 2)))


def q26b_losses(spark, sf_dir):
    """A25 J15 J15b F15 F17c."""
    return rounded(risk.country_losses(_risk_tables(spark, sf_dir)[1]), 4)


def q27_ssp_decomposition(spark, sf_dir):
    """J16."""
    df = _annual(spark, sf_dir, BOTH).filter(F.col("year").isin(YEARS)).groupBy("country", "technology", "year", "climate_ssp", "deploy_ssp").agg((F.sum("generation_mwh") / 1e6).alias("loss"))
    return rounded(scenario.decomposition(df, ["country", "technology", "year"], "loss"))


def q27b_risk_matrix(spark, sf_dir):
    """A26 T10."""
    return rounded(risk.risk_matrix(risk.country_losses(_risk_tables(spark, sf_dir)[1])), 4)


def q28_risk_class(spark, sf_dir):
    """W1."""
    df = _country(spark, sf_dir)
    return rounded(risk.risk_classes(df, ["climate_ssp", "year"], "generation_mwh", "mean_cf"))


def q28b_country_profile(spark, sf_dir):
    """A27 W1 P3 P14."""
    return rounded(risk.country_profile(risk.risk_matrix(risk.country_losses(_risk_tables(spark, sf_dir)[1]))), 4)


def q29_event_contribution(spark, sf_dir):
    """W2 J13."""
    e = views.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25).alias("grp"), "event_type").agg(F.sum("value").alias("value"))
    return rounded(risk.share_of_group(e, ["grp"], "value", "total", "share"))


def q29b_technology_vulnerability(spark, sf_dir):
    """A27 P3."""
    return rounded(risk.technology_vulnerability(risk.country_losses(_risk_tables(spark, sf_dir)[1])), 4)


def q30_window_delta(spark, sf_dir):
    """A20 A20b J11 P5 P5b."""
    o = views.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(generation.window_change(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", (1995, 1996), (1998, 2000)), 4)


def q31_pv_density(spark, sf_dir):
    """F1 F2 F3 F4 F5 F5b F6 F9."""
    lon, lat, cap = F.col("lon"), F.col("lat"), F.col("capacity_gw")
    x, y = geo.web_mercator_to_degrees(lon * 100000.0, lat * 100000.0)
    return rounded(
        views.sites(spark, sf_dir).select(
            "site_id", geo.to_360(lon).alias("lon360"), geo.to_180(lon * 2.0).alias("lon180"), geo.pv_density(lat).alias("pv_density"), geo.polygon_capacity_gw(cap * 1e6, lat).alias("polygon_gw"), geo.turbine_capacity_gw().alias("turbine_gw"),
            geo.grid_capacity_gw(F.col("technology"), F.lit(40.0), F.abs(cap) * 100.0, cap * 20.0).alias("grid_gw"), x.alias("x"), y.alias("y"),
        )
    )


def q32_ssp_normaliser(spark, sf_dir):
    """Parts named with a scenario in one of many spellings."""
    key = F.col("p_partkey")
    spelt = F.element_at(F.array(*map(F.lit, views.SPELLINGS)), (key % len(views.SPELLINGS) + 1).cast("int"))
    path = F.concat(F.lit("results/"), F.when(key % 2 == 0, spelt).otherwise("all"), F.lit("/stations_"), key.cast("string"), F.lit(".csv"))
    named = views.table(spark, sf_dir, "part").select(key.alias("part"), F.concat_ws(" ", spelt, F.regexp_replace("p_name", "[0-9]", "")).alias("name"), path.alias("path"))
    return named.select("part", scalar.ssp_code(F.col("name")).alias("code"), scalar.ssp_from_path(F.col("path")).alias("path_code"))


def q33_set_difference(spark, sf_dir):
    """U3 U4 J17."""
    nation = views.table(spark, sf_dir, "nation")
    rich = views.table(spark, sf_dir, "supplier").filter("s_acctbal > 7000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    missing = coverage.missing_keys(nation, rich, "n_name").withColumn("side", F.lit("missing"))
    return missing.unionByName(coverage.common_keys(nation, rich, "n_name").withColumn("side", F.lit("common")))


def q34_matrix_deviation(spark, sf_dir):
    """W6 W9 A23b A5e."""
    df = generation.weighted_cf(_annual(spark, sf_dir, BOTH), BOTH)
    return rounded(scenario.deviation_from_mean(df.select(*BOTH, "weighted_cf"), ["technology"], "weighted_cf"), 5)


def q34b_pair_difference(spark, sf_dir):
    """W9."""
    df = generation.weighted_cf(_annual(spark, sf_dir, by=("year", "month")), ["technology", "climate_ssp", "month"])
    return rounded(scenario.pair_difference(df, ["technology", "month"], "climate_ssp", "ssp126", "ssp585", "weighted_cf"))


def q35_status_share_by_country(spark, sf_dir):
    """A11b."""
    st = views.stations(spark, sf_dir).select("station_idx", F.when(F.col("country") < "M", F.col("country")).alias("country"))
    return rounded(quality.zero_by_country(views.power(spark, sf_dir).join(st, "station_idx"), "power_gw"))


def q36_projection_filters(spark, sf_dir):
    """Names and buckets of stations' files."""
    p = views.power(spark, sf_dir).filter((F.col("technology") == "solar") & F.col("climate_ssp").isin("ssp126", "ssp585") & F.col("year").between(1996, 1999))
    key = scalar.station_key(F.col("technology"), F.col("climate_ssp"), F.lit("region"), F.col("station_idx"))
    return p.groupBy(key.alias("station_id"), scalar.activation_bucket(F.col("year") + 34).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("power_gw") == 0).alias("n_zero"))


def q36b_zero_cf_stations(spark, sf_dir):
    """P8b P12 P16 P17 T3 SRC1b: stations whose every known step of a year is below a threshold."""
    p = views.power(spark, sf_dir).withColumn("power_gw", F.when(F.col("power_gw") > 0.02 * F.col("month"), 0.0 * F.col("power_gw")))
    return quality.zero_cf_stations(p, views.stations(spark, sf_dir), generation.FILE_KEYS, 1999)


def q36c_missing_mask(spark, sf_dir):
    """P11b P1b."""
    p = views.power(spark, sf_dir).withColumn("power_gw", F.when(F.col("month") > 6, F.col("power_gw")))
    return quality.missing_mask(p, ["station_idx", "technology", "year"], "power_gw").groupBy("technology", "year").agg(F.count_if("missing").alias("n_missing"), F.count("*").alias("n"))


def q43_value_by_family(spark, sf_dir):
    """J19 J19b J8 SRC2c: two regular grids, one curvilinear, and a family without a grid."""
    c = views.cells(spark)
    regular = c.filter("row % 2 = 0").select(F.lit("even").alias("grid_id"), (F.col("row") / 2).cast("int").alias("ilat"), F.col("col").alias("ilon"), (85.0 - 10.0 * F.col("row")).alias("lat"), (5.0 + 10.0 * F.col("col")).alias("lon"), F.col("region_id").cast("double").alias("value"))
    regular = regular.unionByName(c.filter("col % 3 = 0").select(F.lit("third").alias("grid_id"), F.col("row").alias("ilat"), (F.col("col") / 3).cast("int").alias("ilon"), (85.0 - 10.0 * F.col("row")).alias("lat"), (10.0 * F.col("col")).alias("lon"), F.col("region_id").cast("double").alias("value")))
    bent = c.select(F.lit("bent").alias("grid_id"), F.col("row").alias("ilat"), F.col("col").alias("ilon"), (84.0 - 10.0 * F.col("row") + 0.07 * F.col("col")).alias("lat"), (4.0 + 9.5 * F.col("col") + 0.11 * F.col("row")).alias("lon"), F.col("region_id").cast("double").alias("value"))
    family = F.element_at(F.array(*map(F.lit, ["even", "third", "bent", "none"])), (F.col("site_id") % 4 + 1).cast("int"))
    points = views.sites(spark, sf_dir).select("site_id", "lon", "lat", family.alias("grid_id"))
    return spatial.value_by_family(points, regular, bent, "site_id")


def q37_value_counts(spark, sf_dir):
    """A19b P6 P10."""
    p = views.power(spark, sf_dir).filter(~F.col("climate_ssp").isin("ssp245") & scalar.finite(F.col("power_gw")))
    return p.groupBy("technology", "climate_ssp").agg(F.count("*").alias("n"), F.countDistinct("station_idx").alias("n_stations"))


def q38_padded_range(spark, sf_dir):
    """A18."""
    df = generation.positive(_annual(spark, sf_dir), "generation_mwh")
    return rounded(generation.padded_range(df, ["technology"], "generation_mwh", log=True))


def q38b_shared_limits(spark, sf_dir):
    """A18b."""
    return rounded(generation.shared_limits(_annual(spark, sf_dir), {"capacity_factor": (0.92, 1.05), "capacity_mw": (0.8, 1.25)}))


def q39_boundary_points(spark, sf_dir):
    """a hundred points round the sites of each nation."""
    low, high = (lambda c: F.min(c)), (lambda c: F.max(c))
    boxes = views.sites(spark, sf_dir).groupBy("nation_key").agg(low("lon").alias("west"), high("lon").alias("east"), low("lat").alias("south"), high("lat").alias("north"))
    pts = boxes.select("nation_key", F.explode(geo.boundary(F.col("west"), F.col("east"), F.col("south"), F.col("north"), 25)).alias("p"))
    return rounded(pts.select("nation_key", "p.side", "p.step", "p.lon", "p.lat"))


def q40_cell_centres(spark, sf_dir):
    """the one-degree cells with a site, their centres, in column-major order."""
    s = views.sites(spark, sf_dir)
    found = s.select(spatial.raster_index(90.0 - F.col("lat"), 0.0, 1.0, 180).alias("row"), spatial.raster_index(F.col("lon") + 180.0, 0.0, 1.0, 360).alias("col")).groupBy("row", "col").agg(F.count("*").alias("n"))
    lon, lat = geo.cell_centre(F.col("row"), F.col("col"))
    return found.select("row", "col", "n", lon.alias("lon"), lat.alias("lat"), (F.col("col") * 180 + F.col("row")).alias("rank"))


def q41_multipliers(spark, sf_dir):
    """Every nation under every technology, scenario and
    month, with the power that its stations have there, if any."""
    p = views.power(spark, sf_dir).join(views.stations(spark, sf_dir).select("station_idx", "country"), "station_idx")
    sums = p.groupBy("country", "technology", F.col("climate_ssp").alias("ssp"), "month").agg(F.sum("power_gw").alias("power")).withColumn("year", F.element_at(F.array(*map(F.lit, K.YEARS)), F.col("month") % 3 + 1))
    sums = scratch.written(sums)  # its axes and its values
    axis = lambda *c: sums.select(*c).distinct()
    dims = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("country")).crossJoin(axis("technology")).crossJoin(axis("ssp")).crossJoin(axis("month", "year"))
    met = dims.join(sums.drop("year"), ["country", "technology", "ssp", "month"], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
    s, y, t, m, w = (F.col(c) for c in ("ssp", "year", "technology", "month", "power"))
    return rounded(
        met.select(
            "country", s, y, t, m, scalar.deployment_multiplier(s, y).alias("deployment"), scalar.hazard_multiplier(s, y).alias("hazard"), scalar.cf_multiplier(t, s, y).alias("cf"), scalar.season(t, m).alias("season"),
            scalar.days_in_month(m).alias("days"), scalar.sigmoid(w / 100.0).alias("sigmoid"), scalar.annual_generation(w, F.lit(0.25)).alias("generation"),
        )
    )


def q42_study_losses(spark, sf_dir):
    """SRC13 SRC13b: losses by technology of the tables' stations under invented hazards of
    their nations; draws follow from seed and keys."""
    target = F.element_at(F.array(*map(F.lit, K.YEARS)), F.array_position(F.array(*map(F.lit, YEARS)), F.col("year")).cast("int"))
    own = _annual(spark, sf_dir, BOTH).filter(F.col("year").isin(YEARS)).withColumn("target_year", target)
    annual = scratch.written(own.select(
        F.concat_ws("_", "station_idx", "technology", "year").alias("station_id"), "country", "technology", "deploy_ssp", "climate_ssp", "target_year", "capacity_mw",
        F.col("capacity_factor").alias("annual_capacity_factor"), F.col("generation_mwh").alias("annual_generation_mwh"),
    ))
    nations = [r.n_name for r in views.table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]  # 25 of them
    hazard = synth.event_hazard(synth.country_base(spark, 42, nations), 42)
    places = annual.select("station_id").distinct().withColumn("station_extreme_weather_index", synth.Draws(42).uniform("local", "station_id", low=0.8, high=1.2))
    losses = risk.losses(risk.exposures(places, annual, hazard), annual)
    return rounded(risk.technology_vulnerability(risk.country_losses(losses)), 4)


def _dated_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.element_at(F.array(*map(F.lit, K.YEARS)), (F.col("site_id") % 3 + 1).cast("int"))
    return views.sites(spark, sf_dir).withColumns({"year": year, "inside": spatial.in_any_area(F.col("lon"), F.col("lat"))})


def q44_coverage_report(spark, sf_dir):
    """SNK5 SNK5b SNK5c: technologies by year, each year's total last."""
    return rounded(sinks.coverage_report(coverage.coverage_with_total(_dated_sites(spark, sf_dir), "technology", ["year"]), "technology", ("year",)))


def q44b_grid_report(spark, sf_dir):
    """SNK5d: occupied cells by region with names, the sums last and without a name."""
    s = _located(views.sites(spark, sf_dir), drop=True).withColumn("inside", F.col("capacity_gw") > 5)
    found = spatial.grid_by_region(views.cells(spark), spatial.occupancy(s)).join(readers.region_names(spark), "region_id")
    return rounded(sinks.grid_report(found, "region_id", "region_name"), 5)


def q44c_ratio_report(spark, sf_dir):
    """SNK5e SNK5f SNK5g: bad values by technology, country and family of grids."""
    p = views.power(spark, sf_dir)
    status = quality.status_counts(p, ["technology"], "power_gw", F.lit(True)).select(F.lit("status").alias("kind"), F.col("technology").alias("name"), "n", "n_bad", F.col("bad_ratio").alias("ratio"))
    country = quality.zero_by_country(p.join(views.stations(spark, sf_dir).select("station_idx", "country"), "station_idx"), "power_gw").select(F.lit("country").alias("kind"), F.col("country").alias("name"), "n", "n_bad", "ratio")
    family = quality.by_denominator(p, "power_gw", "climate_ssp", {"national": ["ssp126"], "all": K.SSPS}).select(F.lit("family").alias("kind"), F.col("denominator").alias("name"), "n", "n_bad", "ratio")
    return sinks.ratio_report(status.unionByName(country).unionByName(family), "ratio")


def q44d_station_selection(spark, sf_dir):
    """SNK2 F18b: sites as text with fixed decimals; capacities in steps of 1/64, whose
    decimals are no ties."""
    return sinks.station_selection(_dated_sites(spark, sf_dir).withColumns({"type": F.col("technology"), "capacity_gw": F.floor(F.col("capacity_gw") * 64.0) / 64.0 + 0.00001}))


def _scratch(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return f"{scratch.folder(spark)}/windrose-{uuid.uuid4().hex}"


def _as_padded_csv(df: DataFrame, path: str) -> None:
    blank = df.select(*(F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("  ")).alias(c) for c in df.columns))
    blank.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def q45_model_files(spark, sf_dir):
    """SRC9 SRC9b SRC9c SRC9d SRC11 T-8 U1b: countries' factors of three models, each in
    a folder's CSV files, beside the first one's own and a model without files."""
    root = _scratch(spark)
    _country(spark, sf_dir).select(F.col("technology").alias("energy"), F.lit("?").alias("model"), F.col("climate_ssp").alias("scenario"), F.col("country").alias("region"), "year", "mean_cf").write.parquet(f"{root}/all")
    for ssp in K.SSPS:
        _as_padded_csv(spark.read.parquet(f"{root}/all").filter(F.col("scenario") == ssp), f"{root}/models/{ssp}/cf_annual.csv")
    found = readers.discover_models(spark, f"{root}/models", "cf_*.csv", K.SSPS[1:])
    every = readers.models(spark, found).unionByName(readers.optional(spark, f"{root}/models/none/cf_annual.csv", "per_country_annual_cf"))
    base = readers.required(spark, f"{root}/models/{K.SSPS[0]}/cf_annual.csv", "per_country_annual_cf").groupBy("energy", "year").agg(F.avg("mean_cf").alias("base_cf"))
    return rounded(every.groupBy("model", "energy", "year").agg(F.count("*").alias("n"), F.avg("mean_cf").alias("mean_cf")).join(base, ["energy", "year"], "left"))


def q45b_region_files(spark, sf_dir):
    """SRC9e SRC9f SRC10b: regional coverage written with its totals and read without
    them, beside an optional file that isn't there."""
    path = f"{_scratch(spark)}/coverage.csv"
    table = coverage.coverage_with_total(_dated_sites(spark, sf_dir), "nation_key", ["year"])
    _as_padded_csv(table.withColumnsRenamed({"nation_key": "region_id", "cap_total": "cap_total_gw", "cap_inside": "cap_inside_gw"}), path)
    rows = readers.region_rows(spark, path)
    more = readers.optional(spark, f"{path}.none", "region_coverage", trimmed=False)
    return rounded(rows.unionByName(more.withColumn("region_id", F.col("region_id").cast("int"))).drop("region_name"))


def q45c_chosen_files(spark, sf_dir):
    """SRC12 SRC12c SRC12d: results in a folder for each of two years; the last folder's
    first file by pattern, and the file that covers a year."""
    root = _scratch(spark)
    rows = scratch.written(_country(spark, sf_dir).select(F.col("technology").alias("energy"), F.lit("m").alias("model"), F.col("climate_ssp").alias("scenario"), F.col("country").alias("region"), "year", "mean_cf"))
    for year in YEARS[:2]:
        _as_padded_csv(rows.filter(F.col("year") == year), f"{root}/results_{year}/cf_{year}.csv")
    last = readers.first_existing(spark, readers.latest_results(spark, root), ["mean_*.csv", "cf_*.csv"])
    spans = [(f"{root}/results_{y}/cf_{y}.csv", y, y + 1) for y in YEARS[:2]]
    chosen = {"last": last, "covers": readers.file_for_year(spans, YEARS[1] + 1), "none_covers": readers.file_for_year(spans, 1900)}
    tables = [readers.required(spark, path, "per_country_annual_cf").withColumn("choice", F.lit(name)) for name, path in chosen.items()]
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rounded(every.groupBy("choice", "energy", "scenario", "year").agg(F.count("*").alias("n"), F.avg("mean_cf").alias("mean_cf")))


def q46_published_rounding(spark, sf_dir):
    """Halves go to the even neighbour, in the decimals of the published tables."""
    q = F.col("l_quantity").cast("double")
    ties = views.table(spark, sf_dir, "lineitem").groupBy(q.alias("q")).agg(F.count("*").alias("n"))
    q = F.col("q")
    out = [scalar.half_even(q + 0.5, 0).alias("whole"), scalar.half_even(q / 8, 2).alias("hundredths"), scalar.half_even(q / 32 * -1, 4).alias("negative"), scalar.half_even(q / 16, 3).alias("thousandths")]
    return ties.select("q", "n", *out)


def q46b_published_tables(spark, sf_dir):
    """capacity, factor and generation with 4, 6 and 3 decimals."""
    return generation.with_output_rounding(_annual(spark, sf_dir))


def q47_power_files(spark, sf_dir):
    """SRC1 SRC12b U1: power written as files by technology and scenario, not a number
    where it is missing, and read again as the union of both technologies' files."""
    root = _scratch(spark)
    p = views.power(spark, sf_dir).withColumn("power_gw", F.coalesce(F.col("power_gw").cast("double"), F.lit(float("nan"))))
    p.write.partitionBy("technology", "climate_ssp").parquet(root)
    solar, wind = (readers.power(spark, f"{root}/technology={t}").withColumn("technology", F.lit(t)) for t in ("solar", "wind"))
    return rounded(generation.station_period(solar.unionByName(wind), views.stations(spark, sf_dir)))


def q48_station_files(spark, sf_dir):
    """SRC8 SRC8b SRC8c P6b: sites in a padded CSV file, some without a capacity and some
    of a kind or year that isn't known; read for all years and for one."""
    path = f"{_scratch(spark)}/stations.csv"
    kind = F.when(F.col("site_id") % 7 == 0, "tidal").otherwise(F.col("technology"))
    year = F.when(F.col("site_id") % 11 == 0, 2035).otherwise(F.col("year"))
    capacity = F.when(F.col("site_id") % 5 == 0, F.lit("")).otherwise(F.col("capacity_gw").cast("string"))
    _as_padded_csv(_dated_sites(spark, sf_dir).select(year.alias("year"), kind.alias("type"), "lon", "lat", capacity.alias("capacity_gw")), path)
    report = lambda name, years: readers.stations(spark, path, years).groupBy("type", "year").agg(F.count("*").alias("n"), F.sum("capacity_gw").alias("capacity_gw"), F.min("lon").alias("west")).withColumn("choice", F.lit(name))
    return rounded(report("all", None).unionByName(report("one", [2040])))


def q48b_plain_files(spark, sf_dir):
    """SRC10: a table of the library in plain CSV."""
    path = f"{_scratch(spark)}/facilities.csv"
    s = views.sites(spark, sf_dir).select("technology", "lon", "lat", F.when(F.col("site_id") % 3 > 0, F.col("site_id") * 10.0).alias("area_m2"), "capacity_gw")
    s.write.csv(path, header=True)
    return rounded(readers.plain_csv(spark, path, "facilities").groupBy("technology").agg(F.count("*").alias("n"), F.count("area_m2").alias("n_area"), F.sum("area_m2").alias("area_m2"), F.sum("capacity_gw").alias("capacity_gw")), 4)


def q49_zero_denominators(spark, sf_dir):
    """Ratios over denominators that are 0 in many rows, in ANSI mode."""
    value, base = F.col("l_extendedprice"), F.col("l_discount")
    df = views.table(spark, sf_dir, "lineitem").withColumns({"zero": scalar.ratio_or_zero(value, base), "null": scalar.ratio_or_null(value, base), "floor": scalar.ratio_floor_one(value, base), "change": scenario.percent_change(value, base)})
    mean = [F.avg(c).alias(c) for c in ("zero", "null", "floor", "change")]
    return rounded(df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count("null").alias("n_null"), F.count("change").alias("n_change"), *mean), 4)


def q49b_single_precision(spark, sf_dir):
    """Power kept in single precision, summed in doubles."""
    p = views.power(spark, sf_dir).withColumn("power_gw", F.col("power_gw").cast("float"))
    return rounded(generation.totals(generation.station_period(p, views.stations(spark, sf_dir)), ["country", "technology"], "generation_mwh"), 2)


QUERIES = {k: v for k, v in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit() and callable(v)}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if k in QUERIES}
