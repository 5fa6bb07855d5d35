"""Readers of the delimited and JSON inputs, with files chosen as the studies do.

Paths may be on any file system that Spark reads; listings go through Hadoop's
file system API on the driver, and only names are listed, never contents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import constants as K
from ..functions.scalar import known, lookup
from .schemas import SCHEMAS


def _glob(spark: SparkSession, pattern: str) -> list[tuple[str, bool, bool]]:
    """Path, whether it is a folder, whether a link, of each match, in order of name."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((s.getPath().toString(), s.isDirectory(), s.isSymlink()) for s in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_glob(spark, path))


def trimmed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC9, F21: a CSV padded with blanks around names and values; columns are
    found by name, values trimmed and cast."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in raw.columns}
    cell = lambda f: F.trim(F.col(f"`{names[f.name]}`"))
    cast = lambda f: (cell(f) if isinstance(f.dataType, StringType) else cell(f).try_cast(f.dataType)).alias(f.name)
    out = raw.select(*(cast(f) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    doubles = [f.name for f in schema if f.dataType.simpleString() == "double"]
    return out.withColumns({c: known(F.col(c)) for c in doubles}) if doubles else out  # T1


def plain_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """SRC10: a CSV of one of the library's tables."""
    return spark.read.csv(path, header=True, schema=SCHEMAS[table])


def optional(spark: SparkSession, path: str, table: str, trimmed: bool = True) -> DataFrame:
    """SRC9b, SRC10b: the table, or none of its rows where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[table])
    return trimmed_csv(spark, path, SCHEMAS[table]) if trimmed else plain_csv(spark, path, table)


def required(spark: SparkSession, path: str, table: str) -> DataFrame:
    """SRC9c: the table; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return trimmed_csv(spark, path, SCHEMAS[table])


def stations(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """SRC8, SRC8b, SRC8c: station sites of known technologies and years; no capacity is 0."""
    df = trimmed_csv(spark, path, SCHEMAS["stations"])
    df = df.filter(F.col("type").isin(K.TECHS) & F.col("year").isin(list(years or K.YEARS)))
    return df.withColumn("capacity_gw", F.coalesce("capacity_gw", F.lit(0.0)))


def region_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC9e, SRC9f: regional coverage without its total rows."""
    return required(spark, path, "region_coverage").filter("region_id <> 'ALL'").withColumn("region_id", F.col("region_id").cast("int"))


def region_names(spark: SparkSession, path: str | None = None) -> DataFrame:
    """SRC4's names: a JSON object of number to name, or the built-in table (SRC14)."""
    if path is None:
        return spark.createDataFrame(list(enumerate(K.MACRO_REGIONS, 1)), SCHEMAS["region_names"])
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("region_id", "region_name"))
    return raw.select(F.col("region_id").cast("int").alias("region_id"), "region_name")


def areas(spark: SparkSession) -> DataFrame:
    """SRC14: the built-in rectangles in order of precedence."""
    return spark.createDataFrame([(i, *a) for i, a in enumerate(K.AREAS)], SCHEMAS["areas"])


def discover_models(spark: SparkSession, root: str, pattern: str, preference: Sequence[str] = (), excluded: Sequence[str] = ()) -> list[tuple[str, str]]:
    """SRC11, T-8: names and first matching files of the model folders: real ones,
    not excluded, with a match; preferred names first, then by name."""
    out = []
    for path, folder, link in _glob(spark, f"{root}/*"):
        name = path.rstrip("/").rsplit("/", 1)[1]
        if folder and not link and name not in excluded and (files := _glob(spark, f"{path}/{pattern}")):
            out.append((name, files[0][0]))
    rank = {n: i for i, n in enumerate(preference)}
    return sorted(out, key=lambda m: (rank.get(m[0], len(rank)), m[0]))


def models(spark: SparkSession, found: Sequence[tuple[str, str]]) -> DataFrame:
    """SRC9d, U1b: all models' tables, the model column being the folder's name."""
    table = None
    for name, path in found:
        own = trimmed_csv(spark, path, SCHEMAS["per_country_annual_cf"]).withColumn("model", F.lit(name))
        table = own if table is None else table.unionByName(own)
    return table if table is not None else spark.createDataFrame([], SCHEMAS["per_country_annual_cf"])


def file_for_year(spans: Sequence[tuple[str, int, int]], year: int) -> str | None:
    """SRC12: of files with first and last year: none, the only one, the first that
    has the year, else the first."""
    if not spans:
        return None
    return next((p for p, a, b in spans if a <= year <= b), spans[0][0]) if len(spans) > 1 else spans[0][0]


def first_existing(spark: SparkSession, folder: str, patterns: Sequence[str]) -> str | None:
    """SRC12c: the first match of the first pattern that has one."""
    return next((found[0][0] for p in patterns if (found := _glob(spark, f"{folder}/{p}"))), None)


def latest_results(spark: SparkSession, root: str) -> str | None:
    """SRC12d: the last results folder by name."""
    return max((p for p, folder, _ in _glob(spark, f"{root}/results_*") if folder), default=None)


def grids(spark: SparkSession, root: str, grid_ids: Sequence[str] | None = None, year: int | None = None) -> DataFrame:
    """SRC2, SRC2b, SRC2c, SRC3, SRC3b: the canonical grid table (grid_id, ilat, ilon,
    lat, lon, value, and time columns), read once for all grids; a grid without files
    has no rows.  Pruned to grids and a year where asked; NaN becomes NULL (T1)."""
    df = spark.read.parquet(root)
    if grid_ids is not None:
        df = df.filter(F.col("grid_id").isin(list(grid_ids)))
    if year is not None and "year" in df.columns:
        df = df.filter(F.col("year") == year)
    return df.withColumn("value", known(F.col("value")))


def named_polygons(edges: DataFrame, names: dict[str, str], wanted: Sequence[str]) -> DataFrame:
    """SRC5b, J20: edges of the wanted countries only, under the names that are used
    here, numbered in the order of ``wanted``.  Invalid outlines aren't repaired."""
    own = F.coalesce(lookup(F.col("name"), names), F.col("name")) if names else F.col("name")
    at = F.array_position(F.array(*map(F.lit, wanted)), own)
    return edges.withColumns({"poly_ordinal": (at - 1).cast("int"), "name": own}).filter(at > 0)


def power(spark: SparkSession, root: str) -> DataFrame:
    """SRC1, SRC12b, U1: the canonical power table, partitioned by technology, region
    and scenario in place of path builders; NaN becomes NULL."""
    return spark.read.parquet(root).withColumn("power_gw", known(F.col("power_gw")))
