"""Operators on tiny frames with known answers: NULL, NaN, ties, edges, empty groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.functions import geo, scalar
from windrose.operators import cover, coverage, generation, nearest, order_stats, quality, ranking, rings, risk, scenario, spatial, stats

NAN = float("nan")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


POWER = "technology string, climate_ssp string, station_idx int, year int, month int, step_idx int, power_gw double"


@pytest.fixture
def power(spark):
    rows = []
    for step in range(4):
        month = 1 + step // 2
        rows.append(("solar", "ssp126", 1, 2030, month, step, None if step == 0 else 0.5))
        rows.append(("solar", "ssp126", 2, 2030, month, step, NAN))
        rows.append(("solar", "ssp126", 3, 2030, month, step, 0.0))
        rows.append(("solar", "ssp126", 4, 2030, month, step, 1.0))
        rows.append(("solar", "ssp126", 5, 2030, month, step, 1.0))
        rows.append(("solar", "ssp126", 6, 2030, month, step, 1.0))
    return spark.createDataFrame(rows, POWER)


@pytest.fixture
def fleet(spark):
    rows = [(1, 1.0, 2030, "A"), (2, 1.0, 2020, "A"), (3, 2.0, 2020, "A"), (4, 0.0, 2020, "A"), (5, 1.0, 2031, "A"), (6, 1.0, 2020, None)]
    return spark.createDataFrame(rows, "station_idx int, capacity_gw double, activation_year int, country string")


def test_station_year(power, fleet):
    got = {r.station_idx: r for r in generation.station_period(power, fleet).collect()}
    # no data, no capacity, not active yet and no country fall out; an all-zero station stays
    assert set(got) == {1, 3}
    assert got[1].n_steps == 4
    assert got[1].capacity_factor == pytest.approx(1.5 / 4)  # the missing step counts
    assert got[1].generation_mwh == pytest.approx(1.5 * 3 * 1000)
    assert got[3].capacity_factor == 0


def test_station_month_without_data_is_zero(spark, fleet):
    rows = [("solar", "ssp126", 1, 2030, 1, 0, 2.0), ("solar", "ssp126", 1, 2030, 2, 1, None)]
    got = {r.month: r.generation_mwh for r in generation.station_period(spark.createDataFrame(rows, POWER), fleet, ("year", "month")).collect()}
    assert got == {1: 6000.0, 2: 0.0}


def test_generation_is_factor_times_capacity(power, fleet):
    for r in generation.station_period(power, fleet).collect():
        assert r.generation_mwh == pytest.approx(r.capacity_factor * r.capacity_mw * r.n_steps * 3)


def test_country_mean_is_arithmetic_and_skips_null_keys(spark):
    df = spark.createDataFrame([("A", 1.0, 10.0, 0.1), ("A", 3.0, 90.0, 0.3), (None, 1.0, 1.0, 0.9)], "country string, capacity_mw double, generation_mwh double, capacity_factor double")
    df = df.withColumn("year", F.lit(2030))
    (row,) = generation.country_annual(df, ["year"]).collect()
    assert row.mean_cf == pytest.approx(0.2) and row.capacity_mw == 4
    weighted = {r.country: r.weighted_cf for r in generation.weighted_cf(df, ["country"]).collect()}
    assert weighted["A"] == pytest.approx((0.1 + 0.9) / 4)


def test_positive_drops_nan(spark):
    df = spark.createDataFrame([(NAN,), (0.0,), (2.0,), (None,)], "x double")
    assert [r.x for r in generation.positive(df, "x").collect()] == [2.0]


def test_rounding_is_half_even(spark):
    assert one(spark, scalar.half_even(F.lit(2.5), 0)) == 2


def test_ratios(spark):
    assert one(spark, scalar.ratio_or_zero(F.lit(1.0), F.lit(0.0))) == 0
    assert one(spark, scalar.ratio_or_null(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, scalar.ratio_floor_one(F.lit(1.0), F.lit(0))) == 1


@pytest.mark.parametrize(
    ("name", "code"),
    [("SSP1-2.6", "ssp126"), ("ssp2_45", "ssp245"), ("SSP5-8.5", "ssp585"), ("SSP5-6.0", "ssp585"), ("ssp560", "ssp585"), ("ssp370", "ssp370"), ("past", "past")],
)
def test_ssp_names(spark, name, code):
    assert one(spark, scalar.ssp_code(F.lit(name))) == code


def test_ssp_from_path(spark):
    assert one(spark, scalar.ssp_from_path(F.lit("/data/SSP2-4.5/stations.csv"))) == "ssp245"
    assert one(spark, scalar.ssp_from_path(F.lit("/data/stations_base.csv"))) == "base"


def test_station_key(spark):
    assert one(spark, scalar.station_key(F.lit("solar"), F.lit("ssp126"), F.lit("France"), F.lit(12))) == "S126_France_00012"


def test_status_and_sea(spark):
    df = spark.createDataFrame([(None, True), (0.0, True), (1.0, True), (1.0, False), (NAN, True)], "v double, c boolean")
    assert [r.s for r in df.select(scalar.quality_status(F.col("v"), F.col("c")).alias("s")).collect()] == ["bad", "bad", "ok", "nodata", "bad"]
    assert one(spark, scalar.is_sea(F.lit(None).cast("double"))) is False
    assert one(spark, scalar.is_sea(F.lit(0.4))) is True
    assert one(spark, scalar.is_sea(F.lit(1.0), F.lit(NAN))) is True


def test_boxes_over_zero_and_edges(spark):
    box = ("b", 10.0, 350.0, -10.0, 5.0)
    at = lambda lon, lat: one(spark, geo.in_box(F.lit(lon), F.lit(lat), *map(F.lit, box[1:])))
    assert at(-10.0, 10.0) and at(5.0, -10.0) and at(0.0, 0.0)
    assert not at(5.1, 0.0) and not at(0.0, 10.1) and not at(180.0, 0.0)


def test_first_area_wins(spark):
    boxes = [("a", 10.0, 0.0, 0.0, 10.0), ("b", 20.0, 5.0, 5.0, 20.0)]
    area = lambda lon, lat: one(spark, spatial.first_area(F.lit(lon), F.lit(lat), boxes))
    assert (area(7.0, 7.0), area(15.0, 15.0), area(30.0, 0.0)) == ("a", "b", "outside")
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "ordinal int, name string, north double, west double, south double, east double")
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, 15.0, 15.0), (3, 30.0, 0.0)], "id int, lon double, lat double")
    assert {r.id: r.area for r in spatial.first_area_join(points, table, "id").collect()} == {1: "a", 2: "b", 3: "outside"}


def test_rotated_pole(spark):
    lon, lat = geo.to_rotated(F.lit(83.0), F.lit(42.5))
    assert one(spark, lat) == pytest.approx(90.0, abs=1e-5)
    lon, lat = geo.to_rotated(F.lit(-97.0), F.lit(47.5))
    assert one(spark, lat) == pytest.approx(0.0, abs=1e-9) and one(spark, lon) == pytest.approx(0.0, abs=1e-9)


def square(ordinal, name, x0, y0, x1, y1):
    return [(ordinal, name, x0, y0, x1, y0), (ordinal, name, x1, y0, x1, y1), (ordinal, name, x1, y1, x0, y1), (ordinal, name, x0, y1, x0, y0)]


def test_polygons(spark):
    edges = square(0, "left", 0.0, 0.0, 4.0, 4.0) + square(0, "left", 1.0, 1.0, 2.0, 2.0) + square(1, "right", 4.0, 0.0, 8.0, 4.0)
    edges = spark.createDataFrame(edges, "poly_ordinal int, name string, x1 double, y1 double, x2 double, y2 double")
    points = [(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 0.0, 0.0), (5, 9.0, 9.0), (6, 6.0, 1.0)]
    points = spark.createDataFrame(points, "id int, lon double, lat double")
    covers = {r.id: r.polygon for r in spatial.in_polygons(points, edges, "id").collect()}
    assert covers == {1: "left", 2: None, 3: "left", 4: "left", 5: None, 6: "right"}  # 2 lies in the hole
    contains = {r.id: r.polygon for r in spatial.in_polygons(points, edges, "id", boundary=False, default="outside").collect()}
    assert contains == {1: "left", 2: "outside", 3: "outside", 4: "outside", 5: "outside", 6: "right"}


def test_raster_index(spark):
    at = lambda v, **k: one(spark, spatial.raster_index(F.lit(v), 0.0, 0.1, 3600, **k))
    assert at(-5.0) == 0 and at(400.0) == 3599 and at(400.0, drop=True) is None
    assert at(359.97, how="rint") == 3599  # clipped, not wrapped


def test_nearest_axis_ties_and_period(spark):
    at = lambda v, axis, **k: one(spark, spatial.nearest_on_axis(F.lit(v), axis, **k))
    assert at(1.5, [1.0, 2.0]) == 0
    assert at(0.02, [10.0, 359.98], periodic=True) == 1
    assert at(0.02, [10.0, 359.98]) == 0


def test_nearest_cell(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, -1.0)], "cell_id int, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 0.4), (2, 0.0, 0.5), (3, 50.0, 0.0)], "id int, lat double, lon double")
    assert {r.id: r.cell_id for r in spatial.nearest_cell(points, cells, "id", 0.6).collect()} == {1: 1, 2: 1}
    assert {r.id: r.cell_id for r in spatial.nearest_any(points, cells, "id").collect()} == {1: 1, 2: 1, 3: 1}
    strict = spatial.nearest_cell(points.filter("id = 2"), cells, "id", 0.5)
    assert strict.count() == 0  # exactly at the reach


def test_raster_mode(spark):
    grid = {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2, (0, 2): 0, (0, 3): 0, (1, 2): 0, (1, 3): 0, (2, 0): 9}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row int, col int, region_id int")
    got = {(r.row, r.col): r.region_id for r in spatial.raster_mode(cells, 2, 3, 4).collect()}
    assert got == {(0, 0): 1, (0, 1): 0}  # a tie, background only, and the cut-off row


def test_fill_background_takes_the_lowest_tie(spark):
    cells = spark.createDataFrame([(0, 0, 0), (0, 1, 5), (1, 0, 7), (2, 2, 9)], "row int, col int, region_id int")
    wanted = spark.createDataFrame([(0, 0)], "row int, col int")
    assert spatial.fill_background(cells, wanted, "region_id").first().region_id == 5
    far = spark.createDataFrame([(0, 900, 4), (0, 100, 3)], "row int, col int, region_id int")
    assert spatial.fill_background(far, spark.createDataFrame([(0, 850)], "row int, col int"), "region_id").first().region_id == 4


def test_edge_bands_of_an_empty_grid(spark):
    grid = spark.createDataFrame([("g", r, c, None) for r in range(2) for c in range(3)], "g string, row int, col int, value double")
    row = spatial.edge_bands(grid, ["g"]).first()
    assert (row.top, row.bottom, row.left, row.right) == (2, 2, 3, 3)


def test_totals_are_ratios_of_sums(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, 3.0), ("b", True, 4.0)], "k string, inside boolean, capacity_gw double")
    got = {r.k: r for r in coverage.coverage_with_total(df, "k").collect()}
    assert got["ALL"].cap_cover_ratio == pytest.approx(5 / 8) and got["ALL"].n_total == 3
    assert got["ALL"].cap_inside == got["a"].cap_inside + got["b"].cap_inside


def test_dense_regions_keep_zeros(spark):
    regions = spark.createDataFrame([(1,), (2,)], "region_id int")
    df = spark.createDataFrame([(0, 5), (2, 3)], "region_id int, n int")
    assert {r.region_id: r.n for r in coverage.dense_regions(df, regions).collect()} == {1: 0, 2: 3}


def test_increments_clip_falls(spark):
    df = spark.createDataFrame([("c", 2030, 5.0), ("c", 2040, 3.0), ("c", 2050, 4.0), ("d", 2050, 2.0)], "k string, year int, v double")
    got = {r.k: r for r in scenario.increments(df, ["k"], "v", [2030, 2040, 2050]).collect()}
    assert (got["c"].seg_2030, got["c"].seg_2040, got["c"].seg_2050, got["c"].total) == (5, 0, 1, 6)
    assert (got["d"].seg_2030, got["d"].seg_2050) == (0, 2)


def test_decomposition_adds_up_and_keeps_missing(spark):
    rows = [("a", w, p, v) for w, p, v in (("ssp126", "ssp126", 1.0), ("ssp245", "ssp245", 9.0), ("ssp245", "ssp126", 4.0), ("ssp126", "ssp245", 3.0))]
    df = spark.createDataFrame(rows, "k string, climate_ssp string, deploy_ssp string, v double")
    got = {r.target_ssp: r for r in scenario.decomposition(df, ["k"], "v").collect()}
    r = got["ssp245"]
    assert (r.total_change, r.climate_effect, r.deployment_effect, r.interaction_effect) == (8, 3, 2, 3)
    assert got["ssp585"].total_change is None


def test_change_from_a_zero_base_is_null(spark):
    df = spark.createDataFrame([("a", 2030, 0.0), ("a", 2050, 1.0)], "k string, year int, v double")
    assert {r.delta_pct for r in scenario.change_vs_base(df, ["k"], "v", 2030).collect()} == {None}


def test_quadrant_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("p", float(i), float(i % 3), 1.0 + i) for i in range(9)], "panel string, x double, y double, w double")
    assert sum(r.share_pct for r in scenario.quadrants(df, ["panel"], "x", "y", "w").collect()) == pytest.approx(100)


def test_risk_classes_count_equal_as_high(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 3.0, 0.0)], "k string, a double, b double")
    got = {(r.a): r.risk_class for r in risk.risk_classes(df, ["k"], "a", "b").collect()}
    assert got == {1.0: "low_generation_high_risk", 2.0: "high_generation_high_risk", 3.0: "high_generation_low_risk"}


def test_agreement_floor(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0)], "k string, a double, b double")
    assert quality.agreement(df, ["k"], "a", "b").first().jaccard == 0


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("k", float(i)) for i in (1, 2, 3, 4)], "k string, x double")
    r = stats.quantiles(df, ["k"], "x").first()
    assert (r.q25, r.q50, r.q75) == (1.75, 2.5, 3.25)


def test_variation_and_correlation_guards(spark):
    df = spark.createDataFrame([("one", 1.0), ("two", 1.0), ("two", 3.0)], "k string, x double")
    got = {r.k: r.cv_pct for r in stats.variation(df, ["k"], "x").collect()}
    assert set(got) == {"two"} and got["two"] == pytest.approx(math.sqrt(2) / 2 * 100)
    flat = [("c", m, t, 1.0 if t == "solar" else float(m)) for m in range(12) for t in ("solar", "wind")]
    flat = spark.createDataFrame(flat, "k string, month int, t string, v double")
    assert stats.pair_correlation(flat, ["k"], ["month"], "t", "solar", "wind", "v").count() == 0


def test_bins_open_at_the_left(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0), (10.1, 3.0)], "x double, m double")
    bins = spark.createDataFrame([(1,), (2,), (3,)], "bin int")
    got = {r.bin: r.n for r in stats.fixed_bins(df, bins, "x", 0.0, 10.0, "m").collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("k", x) for x in (0.0, 1.0, 1.0, 2.0, 4.0)], "k string, x double")
    rows = stats.density(df, ["k"], "x", -10.0, 14.0, 200).collect()
    assert sum(r.density for r in rows) * 24 / 199 == pytest.approx(1, abs=1e-3)


def test_ranking(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", NAN), ("d", 2.0)], "k string, x double").filter("not isnan(x)")
    assert [r.k for r in ranking.top(df, "x", 2, "k").collect()] == ["d", "a"]
    assert ranking.extremes(df, "x", 8, "k").count() == 6
    wide = spark.createDataFrame([(1.0, NAN, 3.0)], "a double, b double, c double")
    assert wide.select(ranking.row_mean("a", "b", "c").alias("m")).first().m == 2
    assert [r.k for r in ranking.preferred(df, "k", ["d"]).collect()] == ["d", "a", "b"]


def quantile_cases():
    """Ties, wide ranges, gaps, infinities, the smallest doubles, signs, one value."""
    random.seed(2)
    inf = float("inf")
    return [
        [random.gauss(0, 1) for _ in range(400)] + [1e9, -1e12], [1.0] * 90 + [2.0] * 11, [3.5], [random.choice([0.1, 0.2, 7.0]) for _ in range(200)],
        [1.0 + k * 2.0**-52 for k in range(150)] + [1e300 + k * 1e284 for k in range(150)], [float(k) for k in range(100)] + [inf, inf, -inf],
        [k * 5e-324 for k in range(-60, 60)], [-0.0, 0.0, -1e-300, 1e-300] * 30, [1.7e308, -1.7e308] * 20, [2.0**k for k in range(-300, 300)],
    ]


@pytest.mark.parametrize("room", [1, 50, 100_000])
def test_quantiles_of_groups_are_exact(spark, room):
    at = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    cases = quantile_cases()
    rows = [(k, v, -v) for k, values in enumerate(cases) for v in values] + [(k, None, float("nan")) for k in range(len(cases))] + [(None, 1.0, 2.0), (99, None, None)]
    random.shuffle(rows)
    found = order_stats.quantile_table(spark.createDataFrame(rows, "k int, v double, w double"), ["k"], {"v": at, "w": [0.5]}, room)
    got = {r.k: (r.v, r.w) for r in found.collect()}
    assert set(got) == {*range(len(cases)), None, 99} and got[None] == ([1.0] * len(at), [2.0]) and not any(got[99][0] or [])
    for k, values in enumerate(cases):
        ranked = sorted(values)
        for p, x in zip([*at, 0.5], [*got[k][0], -got[k][1][0]], strict=True):
            rank = p * (len(ranked) - 1)
            low = int(rank)
            want = ranked[low] if rank == low else (low + 1 - rank) * ranked[low] + (rank - low) * ranked[low + 1]
            assert x == pytest.approx(want, rel=1e-12, abs=0), (k, p)


@pytest.mark.parametrize("shape", ["gap", "infinite", "uniform"])
def test_little_is_collected_for_quantiles(spark, monkeypatch, shape):
    """Two clusters with a gap, an infinite value, and eleven deciles of uniform values: a
    few passes, and no row of the table on the driver or in a buffer beyond the room."""
    n = 200_000
    v = {"gap": F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10**12), "infinite": F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id")), "uniform": F.xxhash64("id") / 2.0**63}[shape]
    df = spark.range(n).select(v.cast("double").alias("v"))
    tables = []
    monkeypatch.setattr(order_stats, "written", lambda t, f=order_stats.written: tables.append(f(t)) or tables[-1])
    found = stats.whole_quantiles(df, {"v": [i / 10 for i in range(11)]}, room=1000)["v"]
    ranked = np.sort(np.array([r.v for r in df.collect()]))
    want = [float(x) for x in np.quantile(ranked[np.isfinite(ranked)] if shape == "infinite" else ranked, [i / 10 for i in range(11)])]
    if shape == "infinite":
        assert found[-1] == float("inf") and found[5] == (ranked[n // 2 - 1] + ranked[n // 2]) / 2
    else:
        assert found == pytest.approx(want, rel=1e-12)
    assert len(tables) <= 3 + 5  # the input, the ranks, and one of a few rows for each pass
    assert all(t.count() <= 22 for t in tables[1:])


def test_a_group_of_many_values_is_never_gathered(spark):
    """No plan of a large group has an aggregate that holds its values, but those of the room."""
    df = spark.range(300_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 300_007).cast("double").alias("v")).unionByName(spark.range(300_000).select(F.lit(0).cast("long").alias("k"), F.lit(5.5).alias("v")))
    got = {r.k: (r.q50, r.q90) for r in stats.quantiles(df, ["k"], "v", (0.5, 0.9), room=500).collect()}
    for k in (0, 1):
        own = np.array([i * 7919 % 300_007 for i in range(k, 300_000, 2)] + [5.5] * (300_000 * (k == 0)))
        assert got[k] == pytest.approx(tuple(np.quantile(own, [0.5, 0.9])), rel=1e-12)


def test_nested_violins_leave_out_whole_scenarios(spark):
    rows = [("a", y, float(x)) for y in (1, 2) for x in range(5 * y)] + [("b", 1, 1.0), ("b", 1, 2.0)] + [("b", 2, float(x)) for x in range(9)] + [("c", 1, float(x)) for x in range(9)]
    got = stats.nested_violins(spark.createDataFrame(rows, "s string, y int, v double"), ["s"], "y", [1, 2], "v", 0.0, 10.0, 21, 0.42).collect()
    assert {r.s for r in got} == {"a"} and len(got) == 42
    assert max(r.width for r in got) == pytest.approx(0.42)
    own = np.arange(10.0)
    h = own.std(ddof=1) * 10**-0.2
    want = [np.exp(-0.5 * ((g - own) / h) ** 2).sum() / h / math.sqrt(2 * math.pi) for g in np.linspace(0, 10, 21)]
    scaled = [r.width for r in sorted(got, key=lambda r: r.point) if r.y == 2]
    assert scaled == pytest.approx([0.42 * w / max(want) for w in want], rel=1e-9)


def test_wide_polygon_tables_are_joined_by_square(spark):
    """Beyond the bound on edges nothing is broadcast, and the rows are the same; points
    without coordinates and repeated ids keep theirs."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    edges = spark.createDataFrame([(k, f"p{k}", a[0] + k, a[1], b[0] + k, b[1]) for k in (0, 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], EDGES)
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 2.0, 2.0), (3, 4.5, 3.5), (3, 4.5, 3.5), (4, 9.0, 1.0), (5, None, None), (6, 0.0, 0.0), (7, NAN, 1.0)], "id int, lon double, lat double")
    few, many = (spatial.in_polygons(points, edges, "id", most=n) for n in (1000, 3))
    key = lambda r: (r.id, r.polygon or "")
    got = [(r.id, r.polygon) for r in sorted(few.collect(), key=key)]
    assert got == [(r.id, r.polygon) for r in sorted(many.collect(), key=key)] == [(1, "p0"), (2, "p0"), (3, "p1"), (3, "p1"), (4, None), (5, None), (6, "p0"), (7, None)]
    assert "BroadcastHashJoin" in few._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    assert spatial.in_polygons(points, edges.limit(0), "id", default="x").filter("polygon = 'x'").count() == 8


EDGES = "poly_ordinal int, name string, x1 double, y1 double, x2 double, y2 double"


def star(rng, x, y, n, r):
    """An outline of n corners about a place, on a lattice of halves if it is large."""
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(round(2 * (x + r * rng.uniform(0.3, 1) * math.cos(t))) / 2, round(2 * (y + r * rng.uniform(0.3, 1) * math.sin(t))) / 2) for t in at]


@pytest.mark.parametrize("size", [None, 0.7, 3.0, 50.0])
def test_polygons_at_any_size_of_squares(spark, size):
    """Overlapping outlines with holes, level and upright edges, points on corners and
    edges: as a ray over all edges decides."""
    rng = random.Random(4)
    rings = [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.randint(3, 30), rng.choice([3, 9, 15])) for _ in range(12)]
    rings.append([(-30.0, -30.0), (30.0, -30.0), (30.0, 30.0), (-30.0, 30.0)])
    holes = {12: [(-25.0, -25.0), (25.0, -25.0), (25.0, 25.0), (-25.0, 25.0)]}
    pairs = [(k, a, b) for k, r in enumerate(rings) for own in (r, holes.get(k, [])) for a, b in zip(own, own[1:] + own[:1], strict=True) if a != b]
    edges = spark.createDataFrame([(k, f"p{k}", *a, *b) for k, a, b in pairs], EDGES)
    points = [(rng.randrange(-64, 64) / 2, rng.randrange(-64, 64) / 2) for _ in range(600)] + [(rng.uniform(-32, 32), rng.uniform(-32, 32)) for _ in range(300)]

    def by_hand(x, y):
        contains, covers = [], []
        for k in range(len(rings)):
            own = [(*a, *b) for j, a, b in pairs if j == k]
            on = any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in own)
            odd = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1 for x1, y1, x2, y2 in own) % 2
            (covers if on else contains if odd else []).append(k)
        first = contains[0] if contains else None
        return first, first if first is not None else covers[0] if covers else None

    got = cover.polygons_at(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lon double, lat double"), edges, size)
    name = lambda k: None if k is None else f"p{k}"
    assert {r.id: (r.contains, r.covers) for r in got.collect()} == {i: tuple(map(name, by_hand(*p))) for i, p in enumerate(points)}


def test_a_polygon_of_a_million_edges(spark):
    """A wave around a circle: squares hold few edges, and the points are told apart as by
    their radius."""
    n = 1_000_000
    turn = lambda i: 2 * math.pi * i / n
    radius = lambda t: 40.0 + F.sin(t * 60)
    at = lambda i, k: (radius(turn(i)) * (F.cos if k == "x" else F.sin)(turn(i)))
    i, j = F.col("id"), (F.col("id") + 1) % n
    edges = spark.range(n).select(F.lit(0).alias("poly_ordinal"), F.lit("wave").alias("name"), at(i, "x").alias("x1"), at(i, "y").alias("y1"), at(j, "x").alias("x2"), at(j, "y").alias("y2"))
    squares = cover.Squares(edges)
    sizes = cover.polygon_cover(edges, squares).agg(F.max(F.size("edges")).alias("most"), F.count("*").alias("n")).first()
    assert sizes.most < 2000 and sizes.n < 2_500_000
    points = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(90_000)) / 1000 - 45).alias("lon"), (F.pmod(F.xxhash64("id", "id"), F.lit(90_000)) / 1000 - 45).alias("lat"))
    r, t = F.sqrt(F.col("lon") ** 2 + F.col("lat") ** 2), F.atan2("lat", "lon")
    sure = cover.polygons_at(points, edges).withColumn("gap", radius(t) - r).filter(F.abs("gap") > 0.001)
    assert sure.filter(F.col("contains").isNotNull() != (F.col("gap") > 0)).count() == 0 and sure.count() > 2900


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_nearest_places_at_any_distance(spark, leaf):
    """A dense cluster, ties, repeated places, two families, and points far away."""
    rng = random.Random(6)
    cells = [(k, g, rng.choice([rng.uniform(-60, 60), 20 + rng.uniform(0, 1e-3)]), rng.choice([rng.uniform(-200, 400), 100 + rng.uniform(0, 1e-3)])) for k in range(400) for g in (0,)]
    cells += [(1000 + k, 1, float(k % 5), float(k // 5)) for k in range(50)] + [(2000, 1, 0.0, 0.0), (2001, 0, None, 1.0), (2002, 1, NAN, 1.0)]
    points = [(k, k % 2, rng.uniform(-90, 90), rng.uniform(-360, 720)) for k in range(200)] + [(900 + k, 1, k / 4, 2.5) for k in range(20)] + [(950, 2, 0.0, 0.0), (951, 0, None, 0.0), (952, 1, 1e6, -1e6)]
    c, p = spark.createDataFrame(cells, "cell_id int, g int, lat double, lon double"), spark.createDataFrame(points, "id int, g int, lat double, lon double")

    def by_hand(own, across):
        out = {}
        for i, g, y, x in points:
            far = [((v - y) ** 2 + (across(u) - across(x)) ** 2, k) for k, h, v, u in cells if y is not None and v is not None and v == v and (h == g or not own)]
            if far:
                out[i] = min(far)[1]
        return out

    got = nearest.nearest_places(p, c, "id", by=["g"], leaf=leaf)
    assert {r.id: r.cell_id for r in got.collect()} == by_hand(True, lambda v: v % 360.0)
    got = nearest.nearest_places(p, c, "id", degrees=False, leaf=leaf)
    assert {r.id: r.cell_id for r in got.collect()} == by_hand(False, lambda v: v)
    assert nearest.nearest_places(p, c.limit(0), "id").count() == 0


def test_a_far_point_meets_little_of_a_cluster(spark, monkeypatch):
    """Of 40,000 places in a small square, a point far away meets those on its side."""
    c = spark.range(40_000).select("id", (F.col("id") % 200 / 1e4).alias("lat"), (F.floor(F.col("id") / 200) / 1e4 + 50).alias("lon")).unionByName(spark.createDataFrame([(-1, 80.0, 300.0)], "id long, lat double, lon double"))
    p = spark.createDataFrame([(1, -70.0, 80.0)], "q int, lat double, lon double")
    tables = []
    monkeypatch.setattr(nearest, "_FEW", 0)
    monkeypatch.setattr(nearest, "written", lambda t, f=nearest.written: tables.append(f(t)) or tables[-1])
    assert nearest.nearest_places(p, c, "q", "id").first().id == 199 * 200
    y, x = F.lit(-70.0), F.lit(80.0)
    box = F.struct("i", "j", "south", "north", "west", "east")
    last = tables[-1].agg(F.collect_list(box).alias("kids")).select(F.size("kids").alias("all"), F.size(nearest._nearer(F.col("kids"), y, x)).alias("near")).first()
    assert last["all"] > 600 and last["near"] < 40


def test_filling_equals_brute_force(spark):
    """Sparse and dense rasters with ties, empty columns and rows, cells beyond the land."""
    for seed, n, m, share in ((1, 14, 20, 0.05), (2, 30, 9, 0.3), (3, 12, 40, 0.01), (4, 8, 8, 0.9)):
        rng = random.Random(seed)
        cells = [(r, c, rng.choice([1, 2, 3]) if rng.random() < share or (r, c) == (n // 2, m // 2) else 0) for r in range(n) for c in range(m)]
        wanted = [(r, c) for r, c, v in cells if v == 0 and rng.random() < 0.7] + [(-3, -7), (n + 2, m + 9)]
        land = [(r, c, v) for r, c, v in cells if v > 0]
        want = {(r, c): min(((r - a) ** 2 + (c - b) ** 2, a, b, v) for a, b, v in land)[3] for r, c in wanted}
        got = spatial.fill_background(spark.createDataFrame(cells, "row int, col int, v int"), spark.createDataFrame(wanted + wanted[:5], "row int, col int"), "v")
        assert sorted((r.row, r.col, r.v) for r in got.collect()) == sorted((*k, v) for k, v in want.items())
    assert spatial.fill_background(spark.createDataFrame([(0, 0, 0)], "row int, col int, v int"), spark.createDataFrame([(0, 0)], "row int, col int"), "v").count() == 0


def rings_by_hand(cells):
    """Rings of each value as lists of corners, walked side by side."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    out = []
    for value in {v for v in cells.values() if v is not None}:
        own = {k for k, v in cells.items() if v == value}
        sides = {(r + a, c + b, d) for r, c in own for d, ((a, b), (i, j)) in enumerate(zip([(0, 0), (0, 1), (1, 1), (1, 0)], [(-1, 0), (0, 1), (1, 0), (0, -1)], strict=True)) if (r + i, c + j) not in own}
        while sides:
            at = start = min(sides)
            ring = []
            while True:
                sides.discard(at)
                y, x, d = at
                ring.append(at)
                y, x = y + steps[d][0], x + steps[d][1]
                at = next((y, x, t % 4) for t in (d + 1, d, d + 3) if (y, x, t % 4) in sides or (y, x, t % 4) == start)
                if at == start:
                    break
            corners = [(y, x) for k, (y, x, d) in enumerate(ring) if ring[k - 1][2] != d]
            area = sum(x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in zip(corners, corners[1:] + corners[:1], strict=True))
            out.append((value, area < 0, tuple(corners)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.95])
def test_region_rings(spark, share):
    """Noise with corners that only touch, rings in rings, missing cells and a frame."""
    rng = random.Random(int(share * 10))
    cells = {(r, c): rng.choice([1, 2]) if rng.random() < share else rng.choice([0, None]) for r in range(-2, 12) for c in range(5, 19)}
    cells |= {(r, c): 7 if max(abs(r - 30), abs(c - 30)) in (2, 4) else 8 for r in range(25, 36) for c in range(25, 36)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row int, col int, v int")
    found = {}
    for r in rings.region_rings(df, "v").collect():
        found.setdefault((r.value, r.hole, r.ring), []).append((r.seq, r.y, r.x))
    got = sorted((v, hole, tuple((y, x) for _, y, x in sorted(own))) for (v, hole, _), own in found.items())
    assert got == rings_by_hand(cells)
    assert sum(v == 7 and hole for v, hole, _ in got) == 2
    assert rings.region_rings(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("periodic", [False, True])
def test_long_axes(spark, periodic):
    rng = random.Random(8)
    axis = [k / 10 - 180 for k in range(3600)] + [180.0, -180.0, 5.0]
    rng.shuffle(axis)
    values = [rng.uniform(-400, 400) for _ in range(60)] + [k / 20 - 180 for k in range(0, 200)] + [180.0, -180.0, 0.0, 359.96, 1e9]
    across = (lambda v: v % 360.0) if periodic else (lambda v: v)

    def d(a, v):
        x = abs(across(a) - across(v))
        return min(x, 360.0 - x) if periodic else x

    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").coalesce(1)
    for own in (axis, axis[:1], axis[:2]):
        got = [r.i for r in df.select(spatial.nearest_on_axis(F.col("v"), own, periodic).alias("i")).collect()]
        assert got[:-1] == [min((d(a, v), i) for i, a in enumerate(own))[1] for v in values] and got[-1] is None


def test_reports_end_with_their_totals(spark):
    from windrose.sources import sinks

    df = spark.createDataFrame([(2050, "wind", 1), (2030, "ALL", 3), (2030, "wind", 1), (2030, "solar", 2), (2050, "ALL", 1)], "year int, type string, n_total int").withColumns({"n_cover_ratio": F.lit(0.33333), "cap_cover_ratio": F.lit(0.5)})
    assert [(r.year, r.type) for r in sinks.coverage_report(df, "type", ("year",)).collect()] == [(2030, "solar"), (2030, "wind"), (2030, "ALL"), (2050, "wind"), (2050, "ALL")]
    rows = sinks.grid_report(spark.createDataFrame([(10, "b", 1), (2, "a", 4)], "region_id int, region_name string, n int"), "region_id", "region_name").collect()
    assert [tuple(r) for r in rows] == [("2", "a", 4), ("10", "b", 1), ("ALL", "", 5)]
