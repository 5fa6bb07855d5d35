"""Which polygon a point lies in, by a cover of square cells.

The plane is cut into squares, about as many along a side as the root of the number of
edges.  An edge belongs to the squares that it touches.  For each polygon and square it
touches it is also known whether the square's south-eastern corner lies inside: that
many of the polygon's edges cross the square's southern line further east.  Squares
between two of these in a row, whose corner lies inside, lie inside as a whole and need no
edge.  So a point meets the polygons of its own square with the edges there: inside is
what its corner is, turned once for each edge on the way to the eastern side and from
there down to the corner.

Borders of squares are put beside round numbers, so that no outline runs along them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import crosses, on_edge
from ..functions.scalar import known
from ..sources.scratch import spread

#: Where the first border lies before the least coordinates, in squares.
_BESIDE = (0.3819660112501051, 0.2763932022500210)


class Squares:
    """The squares over some edges (x1, y1, x2, y2)."""

    def __init__(self, edges: DataFrame, size: float | None = None):
        low = lambda a, b: F.min(F.least(a, b))
        high = lambda a, b: F.max(F.greatest(a, b))
        way = F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))
        r = edges.agg(low("x1", "x2").alias("x"), low("y1", "y2").alias("y"), high("x1", "x2").alias("xx"), high("y1", "y2").alias("yy"), F.count("*").alias("n"), way.alias("way"), F.count_distinct("poly_ordinal").alias("polygons")).first()
        span = max(r.xx - r.x, r.yy - r.y) if r.n else 1.0
        self.size = size or (span or 1.0) / min(2048, max(8, round(r.n**0.5)))
        self.west, self.south = ((r.x if r.n else 0.0) - _BESIDE[0] * self.size, (r.y if r.n else 0.0) - _BESIDE[1] * self.size)
        #: More than all rows and edges of the cover: an edge touches a square for each of
        #: its ends and each border on its way, and a polygon fills all squares at most.
        self.most = 4 * r.n + (r.way or 0.0) / self.size + r.polygons * (span / self.size + 2) ** 2

    def col(self, x: Column) -> Column:
        return F.floor((x - self.west) / self.size)

    def row(self, y: Column) -> Column:
        return F.floor((y - self.south) / self.size)

    def east_of(self, col: Column) -> Column:
        return self.west + (col + 1) * self.size

    def south_of(self, row: Column) -> Column:
        return self.south + row * self.size


def _at(y: Column) -> Column:
    """Where the edge is at a latitude."""
    return F.col("x1") + (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1"))


def polygon_cover(edges: DataFrame, squares: Squares) -> DataFrame:
    """``poly_ordinal, name, row, col, odd, edges``: the squares that a polygon (edges:
    poly_ordinal, name, x1, y1, x2, y2) touches or fills; odd: whether the south-eastern
    corner lies inside; edges: those that touch it, none where it is filled."""
    near = squares.size * 1e-9  # an edge too many in a square changes nothing
    e = edges.select("poly_ordinal", "name", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = e.withColumn("row", F.explode(F.sequence(squares.row(low - near), squares.row(high + near))))
    ends = [_at(F.greatest(low, squares.south_of(F.col("row")) - near)), _at(F.least(high, squares.south_of(F.col("row") + 1) + near))]
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    level = F.col("y1") == F.col("y2")
    first = F.when(level, left).otherwise(F.greatest(left, F.least(*ends)))
    last = F.when(level, right).otherwise(F.least(right, F.greatest(*ends)))
    touched = rows.select("poly_ordinal", "name", "row", F.explode(F.sequence(squares.col(first - near), squares.col(last + near))).alias("col"), F.struct("x1", "y1", "x2", "y2").alias("edge"), F.lit(0).alias("n"))
    line = squares.south_of(F.col("row"))
    crossed = rows.filter((F.col("y1") > line) != (F.col("y2") > line))
    crossed = crossed.select("poly_ordinal", "name", "row", squares.col(_at(line)).alias("col"), F.when(F.lit(False), F.struct("x1", "y1", "x2", "y2")).alias("edge"), F.lit(1).alias("n"))
    cells = touched.unionByName(crossed).groupBy("poly_ordinal", "name", "row", "col").agg(F.collect_list("edge").alias("edges"), F.sum("n").alias("n"))
    westward = Window.partitionBy("poly_ordinal", "name", "row").orderBy(F.desc("col"))
    further = F.coalesce(F.sum("n").over(westward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("*", further.alias("further"), F.lead("col").over(westward).alias("next"))
    border = cells.select("poly_ordinal", "name", "row", "col", (F.col("further") % 2 == 1).alias("odd"), "edges")
    between = cells.filter(((F.col("further") + F.col("n")) % 2 == 1) & (F.col("next") < F.col("col") - 1))
    filled = between.select("poly_ordinal", "name", "row", F.explode(F.sequence(F.col("next") + 1, F.col("col") - 1)).alias("col"), F.lit(True).alias("odd"), F.slice("edges", 1, 0).alias("edges"))
    return border.unionByName(filled)


def polygons_at(points: DataFrame, edges: DataFrame, size: float | None = None, most: int = 200_000) -> DataFrame:
    """Points (lon, lat) with the columns ``contains``, the first polygon
    (lowest ordinal) that contains the point, and ``covers``, that or else the first with
    the point on its outline; null where there is none, or no place.

    Where there can't be more than ``most`` squares and edges, they are broadcast; else the
    points meet them by square.  One job runs while the result is being built."""
    squares = Squares(edges, size)
    cover = polygon_cover(edges, squares)
    shapes = cover.groupBy("row", "col").agg(F.collect_list(F.struct("poly_ordinal", "name", "odd", "edges")).alias("__shapes"))
    shapes = shapes.withColumnsRenamed({"row": "__row", "col": "__col"})
    if squares.most <= most:
        shapes = F.broadcast(shapes)
    lon, lat = known(F.col("lon")), known(F.col("lat"))
    east, south = squares.east_of(F.col("__col")), squares.south_of(F.col("__row"))

    def place(p: Column) -> Column:
        ends = lambda x, e: (x, lat, e.x1, e.y1, e.x2, e.y2)
        across = F.size(F.filter(p.edges, lambda e: crosses(*ends(lon, e)) != crosses(*ends(east, e))))
        height = lambda e: e.y1 + (e.y2 - e.y1) * F.try_divide(east - e.x1, e.x2 - e.x1)
        down = F.size(F.filter(p.edges, lambda e: ((e.x1 > east) != (e.x2 > east)) & (height(e) <= lat) & (height(e) > south)))
        inside = p.odd != ((across + down) % 2 == 1)
        edge = F.exists(p.edges, lambda e: on_edge(*ends(lon, e)))
        return F.struct(F.when(edge, 1).when(inside, 0).alias("pass"), p.poly_ordinal.alias("ordinal"), p["name"].alias("name"))

    placed = spread(points).withColumns({"__row": squares.row(lat), "__col": squares.col(lon)}).join(shapes, ["__row", "__col"], "left")
    best = F.array_min(F.filter(F.transform("__shapes", place), lambda hit: hit["pass"].isNotNull()))  # what contains comes before what covers
    hits = placed.select(*points.columns, best.alias("__best"))
    return hits.select(*points.columns, F.when(F.col("__best")["pass"] == 0, F.col("__best")["name"]).alias("contains"), F.col("__best")["name"].alias("covers"))
