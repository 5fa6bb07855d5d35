"""Readers, writers and the invented study."""

from __future__ import annotations

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from windrose.functions import constants as K
from windrose.sources import arrays, readers, sinks, synth
from windrose.sources.schemas import SCHEMAS


def test_trimmed_csv(spark, tmp_path):
    f = tmp_path / "cf.csv"
    f.write_text("energy ,  scenario, year , mean_cf\n wind , ssp126 ,2030,  0.25\nsolar, ssp245 , 2040 ,nan\n")
    rows = readers.trimmed_csv(spark, str(f), SCHEMAS["global_annual_cf"]).collect()
    assert [tuple(r) for r in rows] == [("wind", "ssp126", 2030, 0.25), ("solar", "ssp245", 2040, None)]


def test_missing_files(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "no.csv"), "global_annual_cf").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.required(spark, str(tmp_path / "no.csv"), "global_annual_cf")


def test_stations(spark, tmp_path):
    f = tmp_path / "stations.csv"
    f.write_text("year,type,lon,lat,capacity_gw\n2050,solar,1.0,2.0,\n2050,tidal,1,2,3\n2045,wind,1,2,3\n2030,wind,1,2,3.5\n")
    got = {(r.year, r.type): r.capacity_gw for r in readers.stations(spark, str(f)).collect()}
    assert got == {(2050, "solar"): 0.0, (2030, "wind"): 3.5}


def test_discovery(spark, tmp_path):
    for name in ("b", "a", "skip", "bare"):
        (tmp_path / name).mkdir()
        if name != "bare":
            (tmp_path / name / "cf_1.csv").write_text("energy,model,scenario,region,year,mean_cf\nwind,x,ssp126,r,2030,0.1\n")
    found = readers.discover_models(spark, str(tmp_path), "cf_*.csv", ["b"], ["skip"])
    assert [n for n, _ in found] == ["b", "a"]
    assert {r.model for r in readers.models(spark, found).collect()} == {"a", "b"}


def test_choice_of_files(spark, tmp_path):
    assert readers.file_for_year([], 2050) is None
    assert readers.file_for_year([("x", 2000, 2010)], 2050) == "x"
    assert readers.file_for_year([("x", 2000, 2010), ("y", 2040, 2060)], 2050) == "y"
    assert readers.file_for_year([("x", 2000, 2010), ("y", 2011, 2020)], 2050) == "x"
    for d in ("results_1", "results_2"):
        (tmp_path / d).mkdir()
    assert readers.latest_results(spark, str(tmp_path)).endswith("results_2")
    assert readers.first_existing(spark, str(tmp_path), ["no*", "results_*"]).endswith("results_1")


def test_region_names(spark, tmp_path):
    f = tmp_path / "names.json"
    f.write_text('{"1": "North",\n "2": "South"}')
    assert {r.region_id: r.region_name for r in readers.region_names(spark, str(f)).collect()} == {1: "North", 2: "South"}
    assert readers.region_names(spark).count() == 20 and readers.areas(spark).count() == 27


def test_geopackage(spark, tmp_path):
    path = tmp_path / "f.gpkg"
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    polygon = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    head = b"GP\x00\x01" + struct.pack("<i", 3857)
    point = struct.pack("<BI2d", 1, 1, 5.0, 6.0)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom')")
        db.execute("CREATE TABLE t (geom BLOB)")
        db.executemany("INSERT INTO t VALUES (?)", [(head + polygon,), (head + point,), (None,)])
    arrays.register(spark)
    rows = {tuple(r) for r in spark.read.format("geopackage").option("path", str(path)).load().collect()}
    assert rows == {(1.0, 1.0, 4.0), (5.0, 6.0, 0.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2030, "solar", 1.0, 2.0, 3.0), (2050, "wind", 1.25, 2.0, 3.00005)], SCHEMAS["stations"])
    out = sinks.station_selection(df)
    assert [r.year for r in out.collect()] == [2050, 2030]
    assert sinks.write_table(out, str(tmp_path / "csv"), csv=True) == 2
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().lon == "1.3"
    sinks.metadata(spark, str(tmp_path / "meta"), 1, {"t": 2})
    assert '"seed": 1' in spark.read.text(str(tmp_path / "meta")).first().value


@pytest.fixture(scope="module")
def study(spark):
    return synth.study(spark, 7, K.COUNTRIES[:3])


def test_study_shape(study):
    catalog = study["station_catalog"]
    assert catalog.select("station_id").distinct().count() == catalog.count()
    assert catalog.groupBy("country", "deploy_ssp", "target_year", "technology").count().agg(F.min("count")).first()[0] >= 2
    assert study["station_annual"].count() == 3 * catalog.count()
    assert study["station_monthly"].count() == 36 * catalog.count()


def test_study_is_reproducible(spark, study):
    again = synth.study(spark, 7, K.COUNTRIES[:3])["station_catalog"].repartition(7)
    assert again.exceptAll(study["station_catalog"]).count() == 0


def test_study_bounds(study):
    r = study["station_annual"].agg(F.min("annual_capacity_factor"), F.max("annual_capacity_factor")).first()
    assert 0.02 <= r[0] <= r[1] <= 0.72
    shares = study["country_event_contribution"].groupBy("country", "ssp", "target_year").agg(F.sum("event_loss_contribution_fraction").alias("s"))
    assert all(x.s == pytest.approx(1) for x in shares.collect())


def test_risk_counts_capacity_once_for_each_event(study):
    """Two events of wind, three of solar."""
    whole = study["country_annual"].filter("deploy_ssp = 'ssp126' and climate_ssp = 'ssp126' and target_year = 2030")
    risk = study["risk_matrix"].filter("deploy_ssp = 'ssp126' and climate_ssp = 'ssp126' and target_year = 2030")
    whole, risk = ({(r.country, r.technology): r.capacity_mw for r in t.collect()} for t in (whole, risk))
    for (country, tech), v in risk.items():
        assert v == pytest.approx(whole[country, tech] * (2 if tech == "wind" else 3))


def test_q42_runs_over_the_tables_stations(spark):
    """Every nation with a station that counts, losses within generation, and the same draws again."""
    from windrose.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    got = sorted(QUERIES["q42_study_losses"](spark, sf).collect(), key=repr)
    able = QUERIES["q05_coherent_vs_fixed_fleet"](spark, sf).count()
    assert able and got[0].__fields__[0] == "country" and len({r.country for r in got}) > 3
    assert {r.target_year for r in got} == set(K.YEARS) and {r.technology for r in got} == {"solar", "wind"}
    assert all(0 <= r.loss_mwh <= r.exposed_generation_mwh for r in got)
    assert got == sorted(QUERIES["q42_study_losses"](spark, sf).collect(), key=repr)


@pytest.mark.parametrize(("master", "warehouse", "named", "fails"), [("spark://a:7077", "file:/data/w", None, True), ("yarn", "/data/w", None, True), ("yarn", "hdfs://a/w", None, False), ("local[4]", "/data/w", None, False), ("yarn", "/data/w", "hdfs://a/c", False)])
def test_a_cluster_needs_a_shared_folder(master, warehouse, named, fails):
    from unittest.mock import MagicMock

    from windrose.sources import scratch

    spark = MagicMock()
    spark.sparkContext.master = master
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.conf.get = lambda key, default=None: {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": named}.get(key) or default
    if fails:
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.folder(spark)
    else:
        scratch.folder(spark)
        assert spark.sparkContext.setCheckpointDir.call_args[0][0].startswith(named or warehouse)
