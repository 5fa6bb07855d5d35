"""Joins of points with areas, polygons, rasters and axes.

Small sides (areas, axes, polygon edges) are fixed dimensions; a point's own id
carries the results, and ties go to the lowest ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import in_box, to_360
from .cover import polygons_at
from .nearest import nearest_places

OUTSIDE = "outside"


def area_structs(areas=None) -> list[tuple]:
    return list(areas or K.AREAS)


def first_area(lon: Column, lat: Column, areas=None, default: str | None = OUTSIDE) -> Column:
    """The first rectangle that holds the point, as one expression over
    the fixed list, so that no join is needed."""
    found = F.lit(default)
    for name, *box in reversed(area_structs(areas)):
        found = F.when(in_box(lon, lat, *map(F.lit, box)), name).otherwise(found)
    return found


def in_any_area(lon: Column, lat: Column, areas=None) -> Column:
    """Whether any rectangle holds the point."""
    inside = F.lit(False)
    for _, *box in area_structs(areas):
        inside = inside | in_box(lon, lat, *map(F.lit, box))
    return inside


def first_area_join(points: DataFrame, areas: DataFrame, id_col: str, default: str = OUTSIDE) -> DataFrame:
    """J1 for areas in a table (ordinal, name, north, west, south, east): the areas
    gather into one array, which is one row, and each point looks through it."""
    box = F.struct("ordinal", "name", "north", "west", "south", "east")
    rows = areas.agg(F.array_sort(F.collect_list(box)).alias("__areas"))
    lon, lat = F.col("lon"), F.col("lat")
    hit = F.filter("__areas", lambda a: in_box(lon, lat, a.north, a.west, a.south, a.east))
    return points.crossJoin(F.broadcast(rows)).select(id_col, F.coalesce(F.get(hit, F.lit(0))["name"], F.lit(default)).alias("area"))


def in_polygons(points: DataFrame, edges: DataFrame, id_col: str, boundary: bool = True, default: str | None = None, size: float | None = None, most: int = 200_000) -> DataFrame:
    """The first polygon (lowest ordinal) that contains the point; with
    boundary, points on an outline fall to the first polygon that covers them.
    J5b without.

    edges: poly_ordinal, name, x1, y1, x2, y2.  Points without coordinates, and those of
    repeated ids, each give a row.  See ``polygons_at``, which gives both at once."""
    found = polygons_at(points, edges, size, most)
    return found.select(*points.columns, F.coalesce("covers" if boundary else "contains", F.lit(default)).alias("polygon"))


def raster_index(value: Column, origin: float, step: float, size: int, how: str = "floor", drop: bool = False) -> Column:
    """The row or column of a coordinate.  how: floor or rint (half to even).  T17:
    what lies outside is clipped to the edge (J6, J7), or with drop NULL (A10)."""
    raw = (value - origin) / step
    at = (F.rint(raw) if how == "rint" else F.floor(raw)).cast("int")
    if drop:
        return F.when((at >= 0) & (at < size), at)
    return F.least(F.greatest(at, F.lit(0)), F.lit(size - 1))


def raster_lookup(points: DataFrame, cells: DataFrame, value: str, default=0) -> DataFrame:
    """The value of each point's cell (columns row and col on both sides)."""
    return points.join(cells.select("row", "col", value), ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_on_axis(value: Column, axis: list[float], periodic: bool = False) -> Column:
    """The index of the nearest axis value, the first among equals;
    periodic: distances go round 360 degrees.  The axis is a fixed array."""
    first: dict[float, int] = {}
    for i, a in enumerate(axis):
        first.setdefault(float(a) % 360.0 if periodic else float(a), i)
    return nearest_in_axis(value, F.array(*(F.struct(F.lit(a).alias("at"), F.lit(i).alias("i")) for a, i in sorted(first.items()))), len(first), periodic)


def axis_values(axis: Column, periodic: bool = False) -> Column:
    """An array of structs of ``at`` and ``i`` in order, each value with its lowest index;
    periodic: in [0, 360)."""
    if periodic:
        axis = F.transform(axis, lambda a: F.struct(to_360(a["at"]).alias("at"), a["i"].alias("i")))
    ordered = F.array_sort(axis)
    return F.filter(ordered, lambda a, k: (k == 0) | (F.get(ordered, k - 1)["at"] != a["at"]))


def nearest_in_axis(value: Column, axis: Column, n: int, periodic: bool = False) -> Column:
    """J8, J8b for an axis in a column, as ``axis_values`` gives it, of at most ``n``
    values.  Halving finds the place of the value among them; the values on both sides of
    it are compared, and on a circle the ends too."""
    x = to_360(value) if periodic else value
    bounds = F.struct(F.lit(0).alias("low"), F.size(axis).alias("high"))
    half = lambda s: F.floor((s.low + s.high) / 2).cast("int")
    left = lambda s: F.get(axis, half(s))["at"] >= x
    step = lambda s, _: F.when(s.low >= s.high, s).otherwise(F.struct(F.when(left(s), s.low).otherwise(half(s) + 1).alias("low"), F.when(left(s), half(s)).otherwise(s.high).alias("high")))
    place = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, n).bit_length())), bounds, step, lambda s: s.low)
    sides = F.array(place, place - 1, F.lit(0), F.size(axis) - 1) if periodic else F.array(place, place - 1)
    d = lambda a: F.abs(a - x)
    round_ = (lambda a: F.least(d(a), 360.0 - d(a))) if periodic else d
    near = F.transform(F.filter(F.transform(sides, lambda k: F.get(axis, k)), lambda a: a.isNotNull()), lambda a: F.struct(round_(a["at"]).alias("d"), a["i"].alias("i")))
    return F.when(x.isNotNull(), F.array_min(near)["i"])


def nearest_cell(points: DataFrame, cells: DataFrame, id_col: str, reach: float, cell_id: str = "cell_id", strict: bool = True, degrees: bool = True) -> DataFrame:
    """The nearest cell within reach (below it, if strict), planar, in
    degrees with longitude in [0, 360) or else in any unit; the lowest cell id among
    equals.  Both sides meet in squares of that size, a point in the nine around it."""
    across = to_360 if degrees else (lambda x: x)
    square = lambda c: F.floor(c / reach)
    p = points.select(id_col, F.col("lat").alias("__lat"), across(F.col("lon")).alias("__lon"))
    around = F.explode(F.array(*(F.struct((square(F.col("__lat")) + i).alias("a"), (square(F.col("__lon")) + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    p = p.withColumn("__s", around).select(id_col, "__lat", "__lon", F.col("__s.a").alias("a"), F.col("__s.b").alias("b"))
    c = cells.select(F.col(cell_id), F.col("lat").alias("__y"), across(F.col("lon")).alias("__x")).withColumns({"a": square(F.col("__y")), "b": square(F.col("__x"))})
    d2 = (F.col("__y") - F.col("__lat")) ** 2 + (F.col("__x") - F.col("__lon")) ** 2
    met = p.join(c, ["a", "b"]).withColumn("d2", d2).filter(F.col("d2") < reach**2 if strict else F.col("d2") <= reach**2)
    return met.groupBy(id_col).agg(F.min(F.struct("d2", cell_id)).alias("best")).select(id_col, F.col(f"best.{cell_id}").alias(cell_id), F.sqrt("best.d2").alias("distance"))


def nearest_any(points: DataFrame, cells: DataFrame, id_col: str, cell_id: str = "cell_id", degrees: bool = True) -> DataFrame:
    """J9 without a bound: see ``nearest_places``."""
    return nearest_places(points, cells, id_col, cell_id, degrees=degrees)


def fill_background(cells: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """For the wanted cells (row, col) the value of the nearest cell with
    one above 0, the lowest row and column among equals.

    A distance transform in two passes.  Down each column, every wanted row learns the
    nearest such cell of the column, of equals the upper.  Along each row, a wanted cell
    then looks through the columns no further away than the cell of its own: what counts
    there are the squares of both distances.  Cells meet by column, then by row, and never
    each other.  wanted and the result have each cell once."""
    land = cells.filter(F.col(value) > 0).select("row", "col", F.struct("row", F.col(value).alias("value")).alias("land"))
    targets = wanted.select("row", "col").distinct()
    across = land.agg(F.min("col").alias("first"), F.max("col").alias("last"))
    # a place for every wanted row in every column: the raster itself
    places = targets.select("row").distinct().crossJoin(F.broadcast(across)).select("row", F.explode(F.sequence("first", "last")).alias("col"))
    both = land.unionByName(places.withColumn("land", F.lit(None).cast(land.schema["land"].dataType)))
    column = Window.partitionBy("col").orderBy("row")
    above = F.last("land", ignorenulls=True).over(column.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first("land", ignorenulls=True).over(column.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    down = lambda p: F.when(p.isNotNull(), F.struct(F.abs(p["row"] - F.col("row")).cast("long").alias("d"), p["row"].alias("row"), p["value"].alias("value")))
    met = both.select("row", "col", "land", above.alias("above"), below.alias("below")).filter("land IS NULL")
    each = met.select("row", "col", F.least(down(F.col("above")), down(F.col("below"))).alias("near"))
    rows = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "near"))).alias("across"), F.min("col").alias("first"))
    asked = targets.groupBy("row").agg(F.collect_list("col").alias("cols"))

    def nearest(c: Column) -> Column:
        own = F.get("across", (c - F.col("first")).cast("int"))["near"]["d"]
        reach = F.coalesce(F.when(c >= F.col("first"), own), F.greatest(F.size("across").cast("long"), F.abs(c - F.col("first")).cast("long") + 1))
        start = F.greatest(c - reach, F.col("first"))
        part = F.slice("across", (start - F.col("first") + 1).cast("int"), F.greatest(c + reach - start + 1, F.lit(0)).cast("int"))
        known_ = F.filter(part, lambda p: p["near"].isNotNull())
        d2 = lambda p: p["near"]["d"] * p["near"]["d"] + (p["col"] - c).cast("long") * (p["col"] - c).cast("long")
        return F.array_min(F.transform(known_, lambda p: F.struct(d2(p).alias("d2"), p["near"]["row"].alias("row"), p["col"].alias("col"), p["near"]["value"].alias("value"))))["value"]

    found = asked.join(rows, "row").select("row", F.explode(F.transform("cols", lambda c: F.struct(c.alias("col"), nearest(c).alias(value)))).alias("c"))
    return found.select("row", "c.col", F.col(f"c.{value}").alias(value)).filter(F.col(value).isNotNull())


def raster_mode(cells: DataFrame, factor: int, n_rows: int, n_cols: int, value: str = "region_id") -> DataFrame:
    """Blocks of factor x factor cells by their most frequent value other than
    0, the lowest among equals, 0 if there is none; partial blocks are cut off."""
    whole = cells.filter((F.col("row") < n_rows // factor * factor) & (F.col("col") < n_cols // factor * factor))
    block = whole.select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), value)
    counts = block.groupBy("row", "col", value).agg(F.count("*").alias("n"))
    best = F.max_by(value, F.when(F.col(value) > 0, F.struct("n", -F.col(value))))
    return counts.groupBy("row", "col").agg(F.coalesce(best, F.lit(0)).alias(value))


def occupancy(points: DataFrame, keys=("row", "col")) -> DataFrame:
    """Points and capacity by cell and technology, and whether any
    point lies there; points outside the grid have NULL row or column and fall out."""
    inside = points.dropna(subset=list(keys))
    tech = lambda t: F.count_if(F.col("technology") == t)
    return inside.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("capacity_gw").alias("capacity_gw"), (tech("solar") > 0).alias("has_solar"), (tech("wind") > 0).alias("has_wind"), F.bool_or("inside").alias("covered")
    )


def grid_by_region(cells: DataFrame, occupied: DataFrame) -> DataFrame:
    """A10b, A10c, A10d, A7d: land cells, occupied ones by technology and by either
    (an OR, not a sum), covered ones and capacity, by region."""
    met = cells.filter("region_id > 0").join(occupied, ["row", "col"], "left")
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return met.groupBy("region_id").agg(
        F.count("*").alias("n_cells"), flag(F.col("has_solar")).alias("n_solar"), flag(F.col("has_wind")).alias("n_wind"), flag(F.col("has_solar") | F.col("has_wind")).alias("n_any"), flag(F.col("covered")).alias("n_covered"),
        F.coalesce(F.sum("capacity_gw"), F.lit(0.0)).alias("capacity_gw"),
    )


def edge_bands(grid: DataFrame, keys, value: str = "value") -> DataFrame:
    """How many whole rows and columns at each side have no value; the full
    size where nothing has one."""
    has = F.col(value).isNotNull()
    size = lambda c: F.max(c) + 1
    low = lambda c: F.coalesce(F.min(F.when(has, F.col(c))), size(c))
    high = lambda c: F.coalesce(size(c) - 1 - F.max(F.when(has, F.col(c))), size(c))
    return grid.groupBy(*keys).agg(low("row").alias("top"), high("row").alias("bottom"), low("col").alias("left"), high("col").alias("right"))


def axis_step(axis: DataFrame, keys) -> DataFrame:
    """the absolute difference of the first two values of each axis."""
    at = lambda i: F.max(F.when(F.col("index") == i, F.col("value")))
    return axis.groupBy(*keys).agg(F.abs(at(1) - at(0)).alias("step"))


def bands_in_degrees(bands: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame, keys) -> DataFrame:
    """the widths of edge_bands in degrees, by the steps of the grids' axes (keys,
    index, value)."""
    steps = axis_step(lat_axis, keys).withColumnRenamed("step", "__lat").join(axis_step(lon_axis, keys).withColumnRenamed("step", "__lon"), list(keys))
    width = {f"{side}_deg": F.col(side) * F.col(step) for step, sides in (("__lat", ("top", "bottom")), ("__lon", ("left", "right"))) for side in sides}
    return bands.join(steps, list(keys), "left").withColumns(width).drop("__lat", "__lon")


def mesh(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every pair of two axes; a cell grid, so its size is that of the result."""
    return rows.crossJoin(cols)


def nearest_in_grids(points: DataFrame, grids: DataFrame, id_col: str) -> DataFrame:
    """Each point's value in its own regular grid (column grid_id on both
    sides), by the nearest latitude and the nearest longitude around the circle.

    The axes of a grid are two short arrays, so one row of them for each grid meets
    the points; the cells meet them on their indices."""
    axis = lambda v, i: F.collect_set(F.struct(F.col(v).alias("at"), F.col(i).alias("i")))
    axes = grids.groupBy("grid_id").agg(axis("lat", "ilat").alias("__lat"), axis("lon", "ilon").alias("__lon"))
    axes = axes.withColumns({"__lat": axis_values(F.col("__lat")), "__lon": axis_values(F.col("__lon"), periodic=True)})
    longest = 1 << 20  # halvings for axes of any length in use
    met = points.join(axes, "grid_id")
    ilat, ilon = nearest_in_axis(F.col("lat"), F.col("__lat"), longest), nearest_in_axis(F.col("lon"), F.col("__lon"), longest, periodic=True)
    at = met.select(id_col, "grid_id", ilat.alias("ilat"), ilon.alias("ilon"))
    return at.join(grids.select("grid_id", "ilat", "ilon", "value"), ["grid_id", "ilat", "ilon"]).select(id_col, "value")


def value_by_family(points: DataFrame, regular: DataFrame, curvilinear: DataFrame | None, id_col: str) -> DataFrame:
    """points' values from the regular grids and, for the others, from the
    curvilinear grid of their family (nearest cell in degrees); NULL where a family
    has no grid.  J19b: without a curvilinear grid only the regular ones count."""
    found = nearest_in_grids(points, regular, id_col)
    if curvilinear is not None:
        cells = curvilinear.select("grid_id", F.struct("ilat", "ilon", "value").alias("cell_id"), "lat", "lon")
        near = nearest_places(points, cells, id_col, by=["grid_id"])
        found = found.unionByName(near.select(id_col, F.col("cell_id.value").alias("value")))
    return points.select(id_col, "grid_id").join(found, id_col, "left")
