"""Writers of result tables: Parquet at rest, CSV at the edge."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K


def write_table(df: DataFrame, path: str, csv: bool = False, partition_by: tuple[str, ...] = ()) -> int:
    """SNK1, SNK3, SNK6: writes the table, as one CSV file where asked (for small
    reports), and returns its row count, observed while writing."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    out = (df.coalesce(1) if csv else df).write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.csv(path, header=True) if csv else out.parquet(path)
    return seen.get["n"]


def station_selection(df: DataFrame) -> DataFrame:
    """SNK2, F18b: sites as text with fixed decimals, the last year first."""
    text = df.orderBy(F.desc("year"), "type", "lon", F.desc("lat"))
    return text.select("year", "type", F.format_string("%.1f", "lon").alias("lon"), F.format_string("%.1f", "lat").alias("lat"), F.format_string("%.4f", "capacity_gw").alias("capacity_gw"))


def coverage_report(df: DataFrame, key: str, within: tuple[str, ...] = (), total: str = "ALL") -> DataFrame:
    """SNK5, SNK5b, SNK5c: the total row last, of all or in each group of the columns
    ``within``; ratios with four decimals."""
    return df.withColumns({c: F.round(c, 4) for c in ("n_cover_ratio", "cap_cover_ratio")}).orderBy(*within, F.col(key) == total, key)


def grid_report(df: DataFrame, key: str, name: str) -> DataFrame:
    """SNK5d: rows by key and name with the sums of all measures in a last row, where
    the key is ALL and the name is blank."""
    measures = [c for c in df.columns if c not in (key, name)]
    sums = df.agg(*(F.sum(c).alias(c) for c in measures)).select(F.lit("ALL").alias(key), F.lit("").alias(name), *measures)
    rows = df.withColumns({key: F.col(key).cast("string"), "__at": F.col(key).cast("long")})
    return rows.unionByName(sums.withColumn("__at", F.lit(None).cast("long"))).orderBy(F.asc_nulls_last("__at")).drop("__at")


def ratio_report(df: DataFrame, *ratios: str) -> DataFrame:
    """SNK5e, SNK5f, SNK5g: ratios with four decimals."""
    return df.withColumns({c: F.round(c, 4) for c in ratios})


def metadata(spark: SparkSession, path: str, seed: int, tables: dict[str, int]) -> None:
    """SNK4: what was written and from which settings, as one JSON document."""
    said = {"created": datetime.now(UTC).isoformat(timespec="seconds"), "seed": seed, "ssps": K.SSPS, "years": K.YEARS, "technologies": K.TECHS, "events": K.EVENTS, "n_countries": len(K.COUNTRIES), "rows": tables}
    spark.createDataFrame([(json.dumps(said, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
