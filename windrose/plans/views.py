"""The driver's tables seen as power series, stations, sites and rasters.

The same definitions are in SQL in ``oracle``; arithmetic is written alike on
both sides (integers first, then doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_ROWS, N_COLS = 18, 36
#: Rectangles of the sites' world: ordinal, name, north, west, south, east.
BOXES = [
    (0, "north_east", 80.0, 10.0, 20.0, 120.0),
    (1, "overlap", 40.0, 60.0, -10.0, 150.0),
    (2, "over_zero", 30.0, 340.0, -30.0, 20.0),
    (3, "south", -20.0, 200.0, -60.0, 300.0),
    (4, "line", 10.0, 180.0, 10.0, 200.0),
]
#: Polygons as edges: ordinal, name, x1, y1, x2, y2; the first has a hole.
POLYGONS = [
    (0, "frame", -100.0, -50.0, 0.0, -50.0), (0, "frame", 0.0, -50.0, 0.0, 50.0), (0, "frame", 0.0, 50.0, -100.0, 50.0), (0, "frame", -100.0, 50.0, -100.0, -50.0),
    (0, "frame", -70.0, -20.0, -30.0, -20.0), (0, "frame", -30.0, -20.0, -30.0, 20.0), (0, "frame", -30.0, 20.0, -70.0, 20.0), (0, "frame", -70.0, 20.0, -70.0, -20.0),
    (1, "kite", 0.0, -40.0, 80.0, 0.0), (1, "kite", 80.0, 0.0, 0.0, 60.0), (1, "kite", 0.0, 60.0, -10.0, 0.0), (1, "kite", -10.0, 0.0, 0.0, -40.0),
    (2, "inner", -60.0, -10.0, -40.0, -10.0), (2, "inner", -40.0, -10.0, -50.0, 15.0), (2, "inner", -50.0, 15.0, -60.0, -10.0),
]
#: Scenarios as files and folders spell them.
SPELLINGS = ["SSP1-2.6", "ssp126", "SSP 2 4.5", "ssp2_4_5", "ssp585", "SSP5-8.5", "ssp560", "SSP5-6.0", "SSP370x", "history", "ssp245"]
LAT_AXIS = [-60.0 + 7.5 * i for i in range(20)]
LON_AXIS = [12.0 * i for i in range(30)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as power: no value where the discount is 0."""
    ssp = F.when(F.col("l_returnflag") == "A", "ssp126").when(F.col("l_returnflag") == "N", "ssp245").otherwise("ssp585")
    deploy = F.element_at(F.array(F.lit("ssp126"), F.lit("ssp245"), F.lit("ssp585")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "solar").otherwise("wind").alias("technology"), ssp.alias("climate_ssp"), deploy.alias("deploy_ssp"), F.col("l_suppkey").alias("station_idx"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_shipdate").alias("step_idx"), F.when(F.col("l_discount") != 0, F.col("l_discount") * F.col("l_quantity")).alias("power_gw"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as stations, some without capacity."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("station_idx"), F.col("s_acctbal").alias("capacity_gw"), (1995 + F.col("s_suppkey") % 6).cast("int").alias("activation_year"), F.col("n_name").alias("country")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as sites over the globe."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("site_id"), ((key * 377 % 3600) / F.lit(10.0) - 180.0).alias("lon"), ((key * 173 % 1500) / F.lit(10.0) - 65.0).alias("lat"), (F.col("c_acctbal") / 1000.0).alias("capacity_gw"),
        F.when(key % 2 == 0, "solar").otherwise("wind").alias("technology"), F.col("c_nationkey").alias("nation_key"),
    )


def cells(spark: SparkSession) -> DataFrame:
    """A raster of 18 x 36 ten-degree cells with regions 0 (background) to 20."""
    n = spark.range(N_ROWS * N_COLS)
    rc = n.select((F.col("id") / N_COLS).cast("int").alias("row"), (F.col("id") % N_COLS).cast("int").alias("col"))
    return rc.withColumn("region_id", F.when((F.col("row") < 9) & (F.col("col") < 18), 0).otherwise((F.col("row") * 7 + F.col("col") * 3) % 21))


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "ordinal int, name string, north double, west double, south double, east double")


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, "poly_ordinal int, name string, x1 double, y1 double, x2 double, y2 double")
