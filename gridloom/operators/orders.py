"""Orders of cells along which districts are cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, hilbert_index


def hilbert_side(rows: int, cols: int) -> int:
    side = 1
    while side < max(rows, cols, 2):
        side *= 2
    return side


def hilbert_sides(grid: DataFrame) -> DataFrame:
    """(state, side): the least power of two, 2 at least, that covers the state's rows and columns from 0. A state's curve, and so its map,
    does not depend on the states beside it."""
    box = grid.groupBy("state").agg(F.greatest(F.max("r") + 1, F.max("c") + 1, F.lit(2)).alias("n"))
    powers = F.array(*[F.lit(1 << k) for k in range(1, 31)])
    return box.select("state", F.element_at(F.filter(powers, lambda s: s >= F.col("n")), 1).alias("side"))


def hilbert_order(grid: DataFrame, side: int | DataFrame) -> DataFrame:
    """grid with key (place on the curve over side x side, x the column) and ord (0-based within the state). side: a number for all, or
    (state, side), a row a state."""
    if isinstance(side, DataFrame):
        keyed = grid.join(F.broadcast(side), "state").withColumn("key", hilbert_index(F.col("c"), F.col("r"), F.col("side"))).drop("side")
    else:
        keyed = grid.withColumn("key", hilbert_index(F.col("c"), F.col("r"), side))
    return keyed.withColumn("ord", F.row_number().over(Window.partitionBy("state").orderBy("key", "r", "c")).cast("long") - 1)


def spiral_order(grid: DataFrame) -> DataFrame:
    """grid with ord: rings around the cell nearest to the mean row and column, by Chebyshev distance from it; each ring runs
    clockwise from its north-west corner: east along the top, south, west along the bottom, north."""
    mean = grid.groupBy("state").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    d2 = (F.col("r") - F.col("mr")) * (F.col("r") - F.col("mr")) + (F.col("c") - F.col("mc")) * (F.col("c") - F.col("mc"))
    centre = grid.join(F.broadcast(mean), "state").groupBy("state").agg(F.min(F.struct(d2.alias("d2"), "r", "c")).alias("m")).select("state", F.col("m.r").alias("r0"), F.col("m.c").alias("c0"))
    dr, dc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    ring = F.greatest(F.abs(dr), F.abs(dc))
    # The place along the ring's 8 * ring cells; a side owns the corner that it starts from.
    turn = F.when(ring == 0, 0).when((dr == -ring) & (dc < ring), dc + ring).when((dc == ring) & (dr < ring), dr + 3 * ring).when((dr == ring) & (dc > -ring), 5 * ring - dc).otherwise(7 * ring - dr)
    placed = grid.join(F.broadcast(centre), "state").withColumn("ring", ring).withColumn("turn", turn)
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy("state").orderBy("ring", "turn")).cast("long") - 1).drop("r0", "c0", "ring", "turn")


def band_width(grid: DataFrame, ideal: DataFrame) -> DataFrame:
    """(state, k0): about the side of a square that holds one district at the mean density, at least 1."""
    d = grid.groupBy("state").agg(F.sum("pop").alias("p"), F.count(F.lit(1)).alias("n")).join(F.broadcast(ideal), "state")
    return d.select("state", F.greatest(F.lit(1), half_up(F.sqrt(F.col("ideal") / (F.col("p") / F.col("n"))))).cast("int").alias("k0"))


def serpentine_order(grid: DataFrame, widths: DataFrame) -> DataFrame:
    """grid with ord: vertical bands of k0 columns, from the top in even bands and from the bottom in odd ones."""
    b = grid.join(F.broadcast(widths), "state").withColumn("band", F.floor(F.col("c") / F.col("k0")))
    w = Window.partitionBy("state").orderBy("band", F.when(F.col("band") % 2 == 0, F.col("r")).otherwise(-F.col("r")), "c")
    return b.withColumn("ord", F.row_number().over(w).cast("long") - 1).drop("band", "k0")


def centre_order(grid: DataFrame) -> DataFrame:
    """grid with ord: by squared distance from the mean row and column, then row, column."""
    mean = grid.groupBy("state").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    d = grid.join(F.broadcast(mean), "state").withColumn("d2", (F.col("r") - F.col("mr")) * (F.col("r") - F.col("mr")) + (F.col("c") - F.col("mc")) * (F.col("c") - F.col("mc")))
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("state").orderBy("d2", "r", "c")).cast("long") - 1).drop("mr", "mc", "d2")
