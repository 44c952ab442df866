"""Cell populations kept up to date from a stream of blocks (an extension: batch grids need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_cells(blocks: DataFrame) -> DataFrame:
    """(state, r, c, pop, blocks) for outputMode update or complete; the state held is a row a cell, which the grid bounds."""
    return blocks.groupBy("state", "r", "c").agg(F.sum(F.col("pop").cast("long")).alias("pop"), F.count(F.lit(1)).alias("blocks"))


def windowed_cells(blocks: DataFrame, time_column: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """The same by window of event time; rows later than `late` are left out and finished windows are let go."""
    return blocks.withWatermark(time_column, late).groupBy(F.window(time_column, window), "state", "r", "c").agg(F.sum(F.col("pop").cast("long")).alias("pop"))
