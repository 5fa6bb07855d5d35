"""Nearest points without a bound on the distance, by a tree of squares.

Each level cuts a square into 8 by 8; a square is kept as the box of the places in it.
Going down, a query holds the squares whose box is no further than the nearest box's far
corner, so squares that can't hold its nearest place fall out with all that is in them;
at the last level it meets the places of those that are left.  A dense cluster far away is
met in the few squares on its near side.  Distances are planar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import to_360
from ..functions.scalar import known
from ..sources.scratch import spread, written

FANOUT, DEEPEST = 8, 16
#: Places in a square of the last level; more only where the deepest level is reached.
LEAF = 64
#: Squares of a level, or places, that are broadcast to the queries.
_FEW = 100_000


def _square(d: Column) -> Column:
    return d * d


def _nearer(kids: Column, y: Column, x: Column) -> Column:
    """The boxes that may hold the nearest place."""
    gap = lambda low, v, high: F.greatest(low - v, v - high, F.lit(0.0))
    reach = lambda low, v, high: F.greatest(F.abs(v - low), F.abs(v - high))
    most = F.array_min(F.transform(kids, lambda k: _square(reach(k.south, y, k.north)) + _square(reach(k.west, x, k.east))))
    near = lambda m: F.filter(kids, lambda k: _square(gap(k.south, y, k.north)) + _square(gap(k.west, x, k.east)) <= m)
    return F.get(F.transform(F.array(most), near), F.lit(0))  # so that the bound is found once, not for each box


def nearest_places(points: DataFrame, cells: DataFrame, id_col: str, cell_id: str = "cell_id", by: Sequence[str] = (), degrees: bool = True, leaf: int = LEAF) -> DataFrame:
    """``id_col, cell_id, distance``: the nearest cell, at any distance, of
    each point, both lat and lon; planar, in degrees with longitude in [0, 360) or else in
    any unit; the lowest cell id among equals.  by: columns that both sides must agree
    in.  Points without a place, and those whose ``by`` has no cell, fall out.

    The tree is built level by level while the result is being built; the places, and
    levels of many squares, are written once."""
    across = to_360 if degrees else (lambda v: v)
    by = list(by)
    g = F.struct(*map(F.col, by)) if by else F.struct(F.lit(0).alias("all"))
    place = lambda df, *more: df.select(g.alias("g"), *more, known(F.col("lat").cast("double")).alias("y"), known(across(F.col("lon").cast("double"))).alias("x")).dropna(subset=["y", "x"])
    c = written(place(cells, F.col(cell_id).alias("__cell")).groupBy("g", "y", "x").agg(F.min("__cell").alias("__cell")))
    r = c.agg(F.count("*").alias("n"), F.min("y").alias("y"), F.min("x").alias("x"), F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("span")).first()
    span = r.span or 1.0

    def key(v: str, level: int) -> Column:
        low = r[v] or 0.0
        return F.least(F.floor((F.col(v) - low) / span * float(FANOUT**level)), F.lit(FANOUT**level - 1)).cast("long")

    def level_of(level: int) -> DataFrame:
        nodes = c.groupBy("g", key("y", level).alias("i"), key("x", level).alias("j"))
        return nodes.agg(F.count("*").alias("n"), F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east"))

    levels, sizes = [], []
    while not levels or (len(levels) < DEEPEST and sizes[-1].most > leaf):
        levels.append(level_of(len(levels) + 1))
        sizes.append(levels[-1].agg(F.count("*").alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first())
        levels[-1] = written(levels[-1]) if sizes[-1].n > _FEW else levels[-1]
    box = F.struct("i", "j", "south", "north", "west", "east")
    bound = lambda n, df: F.broadcast(df) if n <= _FEW else df
    q = spread(place(points, F.col(id_col).alias("__id")))
    roots = levels[0].groupBy("g").agg(F.collect_list(box).alias("kids"))  # 64 a group at most
    held = q.join(bound(sizes[0].n, roots), "g").select("g", "__id", "y", "x", _nearer(F.col("kids"), F.col("y"), F.col("x")).alias("near"))
    for nodes, size in zip(levels[1:], sizes[1:], strict=True):
        parent = lambda v: F.floor(F.col(v) / FANOUT)
        kids = nodes.groupBy("g", parent("i").alias("i"), parent("j").alias("j")).agg(F.collect_list(box).alias("kids"))
        each = held.select("g", "__id", "y", "x", F.explode("near").alias("k")).select("g", "__id", "y", "x", "k.i", "k.j")
        own = each.join(bound(size.n, kids), ["g", "i", "j"]).select("g", "__id", "y", "x", _nearer(F.col("kids"), F.col("y"), F.col("x")).alias("near"))
        all_ = own.groupBy("g", "__id", "y", "x").agg(F.flatten(F.collect_list("near")).alias("kids"))
        held = all_.select("g", "__id", "y", "x", _nearer(F.col("kids"), F.col("y"), F.col("x")).alias("near"))
    each = held.select("g", "__id", "y", "x", F.explode("near").alias("k")).select("g", "__id", "y", "x", "k.i", "k.j")
    places = c.groupBy("g", key("y", len(levels)).alias("i"), key("x", len(levels)).alias("j")).agg(F.collect_list(F.struct(F.col("y").alias("v"), F.col("x").alias("u"), "__cell")).alias("places"))
    d2 = lambda p: _square(p.v - F.col("y")) + _square(p.u - F.col("x"))
    best = F.array_min(F.transform("places", lambda p: F.struct(d2(p).alias("d2"), p["__cell"].alias("cell"))))
    found = each.join(bound(r.n, places), ["g", "i", "j"]).groupBy("__id").agg(F.min(best).alias("best"))
    return found.select(F.col("__id").alias(id_col), F.col("best.cell").alias(cell_id), F.sqrt("best.d2").alias("distance"))
