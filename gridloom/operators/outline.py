"""In-state cells of a grid from a state's outline: every cell with a block, and every cell whose centre is inside the outline.

The outline is given in degrees, the grid in metres, so a side that is straight on one is bent on the other. Sides are split into
pieces so short that the bend is far less than a cell. Cells beside a piece are few; their centres are projected back and tested
against the outline itself. All other cells lie wholly on one side of it: spans between crossings of each row of cells give those
inside. So only cells of the result and those beside the outline are ever made, never the box around a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CELL_M, to_albers, to_lonlat
from .grid import points_in_polygons

#: Cells that a piece of a side may span; a side of 3 km in degrees bends by less than a metre.
PIECE_CELLS = 2
#: Degrees of latitude of a band of the exact test, about a cell.
BAND = 0.015


def segments(rings: DataFrame) -> DataFrame:
    """(state, x1, y1, x2, y2) of rings (state, ring_id, seq, x, y), closed by their first corner."""
    ring = Window.partitionBy("state", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda k: F.coalesce(F.lead(k).over(ring), F.first(k).over(whole))
    return rings.select("state", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))


def pieces(sides: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(state, x1, y1, x2, y2) in metres: sides, given in degrees, in pieces of at most about PIECE_CELLS cells that meet exactly."""
    ax, ay = to_albers(F.col("x1"), F.col("y1"))
    bx, by = to_albers(F.col("x2"), F.col("y2"))
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) / F.lit(PIECE_CELLS * cell))).cast("int")
    own = sides.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(k, low: str, high: str):
        # The last point is the corner itself, as the next side has it.
        return F.when(k == F.col("n"), F.col(high)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * (k / F.col("n")))

    k = F.col("k")
    own = own.select("state", *[at(x, f"{a}1", f"{a}2").alias(f"{a}{i}") for i, x in ((1, k), (2, k + 1)) for a in ("x", "y")])
    ax, ay = to_albers(F.col("x1"), F.col("y1"))
    bx, by = to_albers(F.col("x2"), F.col("y2"))
    return own.select("state", ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))


def _clipped(cells: DataFrame) -> DataFrame:
    return cells.where("r >= 0 AND r < rows AND c >= 0 AND c < cols").select("state", "r", "c")


def beside(parts: DataFrame, extents: DataFrame, cell: float = CELL_M) -> DataFrame:
    """Cells (state, r, c) of the extents whose centres may be on either side: the boxes around pieces, a cell wider on every side."""
    p = parts.join(F.broadcast(extents), "state")
    row = lambda y: F.floor((F.col("origin_y_top") - y) / F.lit(cell)).cast("int")
    col = lambda x: F.floor((x - F.col("origin_x")) / F.lit(cell)).cast("int")
    p = p.withColumn("r", F.explode(F.sequence(row(F.greatest("y1", "y2")) - 1, row(F.least("y1", "y2")) + 1)))
    p = p.withColumn("c", F.explode(F.sequence(col(F.least("x1", "x2")) - 1, col(F.greatest("x1", "x2")) + 1)))
    return _clipped(p).distinct()


def row_spans(parts: DataFrame, extents: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(state, r, c_from, c_to): of each row of cells the columns whose centres are between an odd crossing of the outline and the next,
    within the extents. A piece meets only the rows whose centres it crosses."""
    p = parts.where("y1 <> y2").join(F.broadcast(extents), "state")
    near = lambda y: (F.col("origin_y_top") - y) / F.lit(cell) - 0.5
    p = p.withColumn("r", F.explode(F.sequence(F.floor(near(F.greatest("y1", "y2"))).cast("int"), F.ceil(near(F.least("y1", "y2"))).cast("int"))))
    p = p.withColumn("y", F.col("origin_y_top") - (F.col("r") + 0.5) * F.lit(cell))
    met = p.where("r >= 0 AND r < rows AND (y1 > y) <> (y2 > y)")
    x = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    row = Window.partitionBy("state", "r").orderBy("x")
    k = met.select("state", "r", "origin_x", "cols", x.alias("x")).withColumn("k", F.row_number().over(row) - 1)
    pairs = k.groupBy("state", "r", "origin_x", "cols", F.floor(F.col("k") / 2).alias("pair")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    first = lambda v: F.ceil((v - F.col("origin_x")) / F.lit(cell) - 0.5)
    spans = pairs.select("state", "r", F.greatest(F.lit(0), first(F.col("x0"))).cast("int").alias("c_from"), F.least(F.col("cols") - 1, first(F.col("x1")) - 1).cast("int").alias("c_to"))
    return spans.where("c_from <= c_to")


def state_cells(blocks: DataFrame, rings: DataFrame, extents: DataFrame, cell: float = CELL_M) -> DataFrame:
    """(state, r, c, pop, blocks) of every in-state cell: those of blocks (state, r, c, pop, blocks; see grid.cells) as they are, and
    cells without a block whose centres are inside the rings (state, ring_id, seq, x, y in degrees, even-odd), with nobody.

    Cells that have a block are not tested. extents: (state, origin_x, origin_y_top, rows, cols), a row a state."""
    on = ["state", "r", "c"]
    sides = segments(rings)
    parts = pieces(sides, cell)
    edge = beside(parts, extents, cell)
    taken = blocks.select(*on)
    x = F.col("origin_x") + (F.col("c") + 0.5) * F.lit(cell)
    y = F.col("origin_y_top") - (F.col("r") + 0.5) * F.lit(cell)
    lon, lat = to_lonlat(x, y)
    asked = edge.join(taken, on, "left_anti").join(F.broadcast(extents), "state").select(*on, lon.alias("x"), lat.alias("y"))
    tested = points_in_polygons(asked, sides, BAND)
    inner = row_spans(parts, extents, cell).select("state", "r", F.explode(F.sequence("c_from", "c_to")).alias("c"))
    inner = inner.join(edge.unionByName(taken), on, "left_anti")
    none = F.lit(0).cast("long")
    empty = tested.unionByName(inner).select(*on, none.alias("pop"), none.alias("blocks"))
    return blocks.select(*on, "pop", "blocks").unionByName(empty)
