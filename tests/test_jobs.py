"""Whole runs on tiny files."""

from __future__ import annotations

import pytest

from windrose.__main__ import main


def test_prepare(spark, tmp_path):
    power = [("solar", r, "ssp126", 1, 2030, 1 + s // 2, s, 0.5 if r == "east" else 1.0) for r in ("east", "west") for s in range(4)]
    power += [("solar", "east", "ssp126", 1, 2035, 1, 0, 9.0), ("solar", "east", "ssp370", 1, 2030, 1, 0, 9.0)]
    schema = "technology string, region string, climate_ssp string, station_idx int, year int, month int, step_idx int, power_gw double"
    spark.createDataFrame(power, schema).write.partitionBy("technology", "region", "climate_ssp").parquet(f"{tmp_path}/power")
    stations = [("solar", r, "ssp126", 1, 1.0, 2030, lon, 1.0) for r, lon in (("east", 1.0), ("west", 50.0))]
    spark.createDataFrame(stations, "technology string, region string, climate_ssp string, station_idx int, capacity_gw double, activation_year int, station_lon double, station_lat double").write.parquet(f"{tmp_path}/stations")
    edges = [(0, "Land", 0.0, 0.0, 2.0, 0.0), (0, "Land", 2.0, 0.0, 2.0, 2.0), (0, "Land", 2.0, 2.0, 0.0, 2.0), (0, "Land", 0.0, 2.0, 0.0, 0.0)]
    spark.createDataFrame(edges, "poly_ordinal int, name string, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{tmp_path}/edges")
    rows = main(["prepare", "--power", f"{tmp_path}/power", "--stations", f"{tmp_path}/stations", "--polygons", f"{tmp_path}/edges", "--out", f"{tmp_path}/out"])
    assert rows == {"station_annual": 1, "station_monthly": 2, "country_annual": 1}  # the western station lies in no country
    r = spark.read.parquet(f"{tmp_path}/out/station_annual").first()
    assert (r.station_id, r.country, r.annual_capacity_factor, r.annual_generation_mwh, r.deploy_ssp) == ("S126_east_00001", "Land", 0.5, 6000.0, "ssp126")


def test_coverage(spark, tmp_path):
    (tmp_path / "stations_SSP1-2.6.csv").write_text("year,type,lon,lat,capacity_gw\n2030,solar,10,50,2\n2030,wind,-170,0,1\n2050,wind,10,50,4\n")
    cells = [(int((90 - 50) / 0.1), int((10 + 180) / 0.1), 6)]
    spark.createDataFrame(cells, "row int, col int, region_id int").write.parquet(f"{tmp_path}/raster")
    rows = main(["coverage", "--stations", f"{tmp_path}/stations_SSP1-2.6.csv", "--out", f"{tmp_path}/out", "--raster", f"{tmp_path}/raster"])
    assert rows == {"coverage": 5, "coverage_by_region": 42}
    got = spark.read.csv(f"{tmp_path}/out/coverage", header=True, inferSchema=True)
    total = got.filter("type = 'ALL' and year = 2030").first()
    assert (total.n_total, total.n_inside, total.cap_cover_ratio, total.ssp) == (2, 1, pytest.approx(0.6667), "ssp126")
    region = spark.read.csv(f"{tmp_path}/out/coverage_by_region", header=True, inferSchema=True)
    assert region.filter("region_id = '6' and year = 2050").first().cap_total == 4 and region.filter("region_id = '1'").first().n_total == 0


def test_study(spark, tmp_path):
    from windrose.plans import jobs

    rows = jobs.study(spark, str(tmp_path), 3, ["Japan"])
    assert rows["station_monthly"] == 12 * rows["station_annual"] == 36 * rows["station_catalog"]
    parts = spark.read.parquet(f"{tmp_path}/risk_decomposition").collect()
    assert len(parts) == 2 * 3 * 2
    for r in parts:
        assert r.total_change == pytest.approx(r.climate_effect + r.deployment_effect + r.interaction_effect)
