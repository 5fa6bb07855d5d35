"""Array and vector files as Spark data sources, for where their libraries exist.

Each is a Python data source that yields rows of a canonical table, a partition
for each file, so files are read by executors in parallel; the libraries are
imported there, and a missing one is an error that names it.  Register with
``register(spark)``, then ``spark.read.format("station_power").load(paths)``.
GeoPackages need only sqlite3 and the geometry header, so they always work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _needed(name: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"reading this format needs {name}") from e


class _Files(DataSourceReader):
    """One partition for each path of the option ``path`` (separated by commas)."""

    def __init__(self, options: dict, read):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.options, self._read = dict(options), read

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self._read(partition.value, self.options)


def _power_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC1, SRC1b: one row for each time step and station; fills become NULL."""
    nc = _needed("netCDF4")
    with nc.Dataset(path) as f:
        time = f["time"]
        dates = nc.num2date(time[:], time.units)
        power = f["power"]
        for step, date in enumerate(dates):
            row = power[step]
            for station, value in enumerate(row.filled(float("nan")) if hasattr(row, "filled") else row):
                yield station, date.year, date.month, step, None if value != value else float(value)


def _grid_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC2, SRC2b, SRC3: one row for each time step and cell of a variable."""
    nc = _needed("netCDF4")
    with nc.Dataset(path) as f:
        var, lat, lon = f[options["variable"]], f[options.get("lat", "lat")][:], f[options.get("lon", "lon")][:]
        for step in range(var.shape[0]) if var.ndim == 3 else [None]:
            plane = var[:] if step is None else var[step]
            plane = plane.filled(float("nan")) if hasattr(plane, "filled") else plane
            for i in range(plane.shape[0]):
                for j in range(plane.shape[1]):
                    y, x = (lat[i, j], lon[i, j]) if lat.ndim == 2 else (lat[i], lon[j])
                    v = float(plane[i, j])
                    yield step or 0, i, j, float(y), float(x), None if v != v else v


def _raster_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC4, SRC4b (then raster_mode): cells of the first band other than background."""
    with _needed("rasterio").open(path) as f:
        band = f.read(1)
        for r, c in zip(*band.nonzero(), strict=True):
            yield int(r), int(c), int(band[r, c])


def _polygon_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC5: edges of each ring of each feature with a name and a geometry."""
    shapes = _needed("shapefile").Reader(path)
    name_at = [f[0] for f in shapes.fields[1:]].index(options.get("name", "NAME"))
    for ordinal, feature in enumerate(shapes.iterShapeRecords()):
        name, points = feature.record[name_at], feature.shape.points
        if not name or not points:
            continue
        bounds = [*feature.shape.parts, len(points)]
        for ring, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            for (x1, y1), (x2, y2) in zip(points[a:b], points[a + 1 : b], strict=False):
                yield ordinal, name, ring, float(x1), float(y1), float(x2), float(y2)


def _matrix_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC7, SRC7b (then grid_capacity_gw): cells of a matrix other than 0."""
    data = _needed("scipy.io").loadmat(path)[options.get("variable", "data")]
    for r, c in zip(*data.nonzero(), strict=True):
        yield int(r), int(c), float(data[r, c])


def _wkb_centroid(blob: bytes) -> tuple[float, float, float]:
    """x, y and area of a point, polygon or multipolygon in a GeoPackage geometry."""
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    at = 8 + envelope

    def geometry(at: int) -> tuple[int, list[tuple[float, float, float]]]:
        order = "<" if blob[at] else ">"
        kind = struct.unpack_from(order + "I", blob, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            x, y = struct.unpack_from(order + "2d", blob, at)
            return at + 16, [(x, y, 0.0)]
        n = struct.unpack_from(order + "I", blob, at)[0]
        at += 4
        parts = []
        for k in range(n):
            if kind == 3:
                m = struct.unpack_from(order + "I", blob, at)[0]
                flat = struct.unpack_from(order + f"{2 * m}d", blob, at + 4)
                at += 4 + 16 * m
                ring = list(zip(flat[::2], flat[1::2], strict=True))
                a = cx = cy = 0.0
                for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                    w = x1 * y2 - x2 * y1
                    a, cx, cy = a + w / 2, cx + (x1 + x2) * w / 6, cy + (y1 + y2) * w / 6
                sign = 1 if k == 0 else -1  # further rings are holes
                scale = sign * (1 if a >= 0 else -1)
                parts.append((cx * scale, cy * scale, a * scale))
            else:
                at, inner = geometry(at)
                parts += inner
        if kind == 3:
            return at, [tuple(map(sum, zip(*parts, strict=True)))]
        return at, parts

    _, parts = geometry(at)
    if len(parts) == 1 and parts[0][2] == 0:
        return parts[0]
    x, y, area = map(sum, zip(*parts, strict=True))
    return (x / area, y / area, area) if area else (float("nan"), float("nan"), 0.0)


def _geopackage_rows(path: str, options: dict) -> Iterator[tuple]:
    """SRC6, SRC6b: centroid, in the file's own projection, and area of each feature."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        table, column = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns LIMIT 1").fetchone()
        for (blob,) in db.execute(f'SELECT "{column}" FROM "{table}" WHERE "{column}" IS NOT NULL'):
            yield _wkb_centroid(blob)


def _source(kind: str, ddl: str, rows) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> DataSourceReader:
            return _Files(self.options, rows)

    return Source


SOURCES = [
    _source("station_power", "station_idx int, year int, month int, step_idx int, power_gw double", _power_rows),
    _source("grid_array", "time_idx int, ilat int, ilon int, lat double, lon double, value double", _grid_rows),
    _source("region_raster", "row int, col int, region_id int", _raster_rows),
    _source("polygon_edges", "poly_ordinal int, name string, ring int, x1 double, y1 double, x2 double, y2 double", _polygon_rows),
    _source("matrix_cells", "row int, col int, value double", _matrix_rows),
    _source("geopackage", "x double, y double, area double", _geopackage_rows),
]


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
