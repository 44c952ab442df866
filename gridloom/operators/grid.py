"""Blocks to grid cells, and what a grid is checked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CELL_M


def extent(points: DataFrame, cell: float = CELL_M) -> DataFrame:
    """One row a state: origin snapped to whole cells a cell beyond the outermost points, rows and columns."""
    m = F.lit(cell)
    box = points.groupBy("state").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    box = box.withColumn("origin_x", F.floor((F.col("min_x") - m) / m) * m).withColumn("origin_y_top", F.ceil((F.col("max_y") + m) / m) * m)
    return box.select(
        "state", "origin_x", "origin_y_top",
        F.ceil((F.col("origin_y_top") - (F.col("min_y") - m)) / m).cast("int").alias("rows"),
        F.ceil((F.col("max_x") + m - F.col("origin_x")) / m).cast("int").alias("cols"),
    )


def bin_points(points: DataFrame, extents: DataFrame, cell: float = CELL_M) -> DataFrame:
    """points with r (0 is north) and c (0 is west). extents has a row a state and is broadcast."""
    m = F.lit(cell)
    joined = points.join(F.broadcast(extents), "state")
    return joined.withColumn("r", F.floor((F.col("origin_y_top") - F.col("y")) / m).cast("int")).withColumn("c", F.floor((F.col("x") - F.col("origin_x")) / m).cast("int"))


def cells(blocks: DataFrame) -> DataFrame:
    """(state, r, c, pop, blocks): populations summed by cell, partly before the shuffle."""
    return blocks.groupBy("state", "r", "c").agg(F.sum(F.col("pop").cast("long")).alias("pop"), F.count(F.lit(1)).alias("blocks"))


def cell_blocks(blocks: DataFrame) -> DataFrame:
    """(state, r, c, geoids): each populated cell's ids, sorted."""
    return blocks.where("pop > 0").groupBy("state", "r", "c").agg(F.array_sort(F.collect_list("geoid")).alias("geoids"))


def neighbour_edges(grid: DataFrame, *keys: str) -> DataFrame:
    """(state, keys.., r, c, nr, nc) for every two cells side by side, both ways: one explode and one equi-join."""
    on = ["state", *keys]
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("d")
    ask = grid.select(*on, "r", "c", steps).select(*on, "r", "c", (F.col("r") + F.col("d.dr")).alias("nr"), (F.col("c") + F.col("d.dc")).alias("nc"))
    there = grid.select(*on, F.col("r").alias("nr"), F.col("c").alias("nc"))
    return ask.join(there, [*on, "nr", "nc"], "left_semi").select(*on, "r", "c", "nr", "nc")


def boundary(grid: DataFrame) -> DataFrame:
    """Cells with fewer than four neighbours."""
    n = neighbour_edges(grid).groupBy("state", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["state", "r", "c"], "left").where(F.coalesce("n", F.lit(0)) < 4).select("state", "r", "c", F.coalesce("n", F.lit(0)).cast("int").alias("neighbours"))


def in_state(binned: DataFrame, inside: DataFrame) -> DataFrame:
    """Cells where any block lands, populated or not, or whose centre is inside the polygon."""
    return binned.select("state", "r", "c").unionByName(inside.select("state", "r", "c")).distinct()


def conservation(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """(state, pop, resident_pop, ok): cell populations must add up to the published ones."""
    total = grid.groupBy("state").agg(F.sum("pop").cast("long").alias("pop"))
    return expected.join(total, "state", "left").select("state", F.coalesce("pop", F.lit(0)).cast("long").alias("pop"), "resident_pop", F.coalesce(F.col("pop") == F.col("resident_pop"), F.lit(False)).alias("ok"))


def conserved(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """grid, raising before a row is given where a state's people do not add up to resident_pop, or none are known. expected: (state,
    resident_pop), a row a state."""
    checked = conservation(grid, grid.select("state").distinct().join(F.broadcast(expected), "state", "left"))
    said = F.concat(F.lit("people of the cells of "), F.col("state").cast("string"), F.lit(": "), F.col("pop").cast("string"), F.lit(", published: "), F.coalesce(F.col("resident_pop").cast("string"), F.lit("none")))
    passed = checked.select("state", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")).alias("passed"))
    return grid.join(F.broadcast(passed), "state").where("passed").drop("passed")


def require(ok: DataFrame, column: str, message: str) -> DataFrame:
    """ok, but raising where the column is not true."""
    return ok.withColumn(column, F.when(F.col(column), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def points_in_polygons(points: DataFrame, segments: DataFrame, band: float) -> DataFrame:
    """Points (state, r, c, x, y) inside the even-odd area of their state's ring segments (state, x1, y1, x2, y2).

    Segments are listed under every band of y that they cross and meet only the points of that band: an equi-join
    in place of a loop over all pairs."""
    level = lambda y: F.floor(y / F.lit(band))
    cut = segments.where("y1 <> y2").withColumn("band", F.explode(F.sequence(level(F.least("y1", "y2")), level(F.greatest("y1", "y2")))))
    p = points.withColumn("band", level(F.col("y")))
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = p.join(cut, ["state", "band"]).where(crossing).groupBy("state", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") % 2 == 1).select("state", "r", "c")


def ring_area(rings: DataFrame) -> DataFrame:
    """(state, ring_id, area): shoelace sum over the vertices in order, closed by the first; counter-clockwise is positive."""
    from pyspark.sql import Window

    w = Window.partitionBy("state", "ring_id").orderBy("seq")
    whole = Window.partitionBy("state", "ring_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def after(name: str) -> Column:
        return F.coalesce(F.lead(name).over(w), F.first(name).over(whole))

    step = rings.withColumn("nx", after("x")).withColumn("ny", after("y"))
    return step.groupBy("state", "ring_id").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))
