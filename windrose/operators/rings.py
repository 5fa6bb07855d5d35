"""The regions of a raster as rings of corners.

A side of a cell is part of an outline where the cell beyond it has another value or is
missing.  Sides are directed, with their region to the right, so each belongs to one cell
and is followed by one other; where two cells of a region touch at a corner only, the
outline stays with its own cell.  Rings are found by pointer doubling: in each round every
side looks twice as far along its ring, so rounds grow with the logarithm of the longest
ring and every round is one join of the sides with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Steps in rows and columns to the east, south, west and north, by number.
_DOWN, _ACROSS = (0, 1, 0, -1), (1, 0, -1, 0)
#: A side's start from its cell's upper left corner: upper, right, lower, left side.
_STARTS = ((0, 0), (0, 1), (1, 1), (1, 0))


def _element(values: tuple[int, ...], at: str):
    return F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)


def _sides(cells: DataFrame, value: str) -> DataFrame:
    """``value, y, x, d``: where the directed sides of outlines start, and where they go."""
    each = F.array(*(F.struct((F.col("row") + a).alias("y"), (F.col("col") + b).alias("x"), F.lit(d).alias("d")) for d, (a, b) in enumerate(_STARTS)))
    sides = cells.filter(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.explode(each).alias("s")).select("value", "s.*")
    # the two cells beside a side go along it in opposite directions
    line = F.least(F.struct("y", "x"), F.struct((F.col("y") + _element(_DOWN, "d")).alias("y"), (F.col("x") + _element(_ACROSS, "d")).alias("x")))
    alone = sides.groupBy("value", line.alias("line"), (F.col("d") % 2).alias("upright")).agg(F.count("*").alias("n"), F.first("y").alias("y"), F.first("x").alias("x"), F.first("d").alias("d"))
    return alone.filter("n = 1").select("value", "y", "x", "d")


def region_rings(cells: DataFrame, value: str) -> DataFrame:
    """``value, ring, hole, seq, x, y`` for each corner of each ring around the cells
    (row, col, each once) of a value; x and y are borders of columns and rows, seq orders a
    ring's corners from its topmost, of those its leftmost, clockwise as the raster lies, and holes the other
    way round.  ring tells rings apart.  Cells without a value belong to no region.

    Each round of doubling is written while the result is being built."""
    sides = written(_sides(cells, value))
    r = sides.agg(F.min("y").alias("y"), F.min("x").alias("x"), F.max("x").alias("xx")).first()
    if r.y is None:
        return sides.select("value", F.lit(0).cast("long").alias("ring"), F.lit(False).alias("hole"), F.lit(0).cast("long").alias("seq"), "x", "y")
    width = r.xx - r.x + 1
    number = lambda y, x, d: (((y - r.y).cast("long") * width + (x - r.x)) * 4 + d).cast("long")
    ends = sides.select("*", (F.col("y") + _element(_DOWN, "d")).alias("yy"), (F.col("x") + _element(_ACROSS, "d")).alias("xx"))
    leaving = sides.groupBy("value", F.col("y").alias("yy"), F.col("x").alias("xx")).agg(F.collect_set("d").alias("ways"))  # two at most
    turn = lambda k: (F.col("d") + k) % 4
    way = F.when(F.array_contains("ways", turn(1)), turn(1)).when(F.array_contains("ways", turn(0)), turn(0)).otherwise(turn(3))
    met = ends.join(leaving, ["value", "yy", "xx"])
    chain = written(met.select("value", "y", "x", "d", number(F.col("y"), F.col("x"), F.col("d")).alias("id"), number(F.col("yy"), F.col("xx"), way).alias("next"), (way != F.col("d")).alias("turns"), (F.col("x") * F.col("yy") - F.col("xx") * F.col("y")).cast("long").alias("area")))

    # the least side of each ring
    now = written(chain.select("id", F.col("next").alias("to"), F.least("id", "next").alias("low")))
    while True:
        further = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = written(now.join(further, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        changed = not new.filter("changed").isEmpty()
        now = new.select("id", "to", "low")
        if not changed:
            break
    # steps to it along the ring
    rings = now.select("id", F.col("low").alias("ring"))
    placed = chain.join(rings, "id")
    steps = written(placed.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("steps")))
    while not steps.filter("to IS NOT NULL").isEmpty():
        further = steps.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        steps = written(steps.join(further, "to", "left").select("id", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")))
    area = placed.groupBy("ring").agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    corners = placed.filter("turns").select(F.col("next").alias("id"))
    found = placed.drop("area").join(corners, "id", "left_semi").join(steps.select("id", "steps"), "id").join(area, "ring")
    return found.select("value", "ring", (F.col("area") < 0).alias("hole"), (F.col("n") - F.col("steps")).alias("seq"), "x", "y")
