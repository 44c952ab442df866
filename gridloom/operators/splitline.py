"""Recursive shortest balanced cuts, all regions of all states a level at a time.

A region is (state, seat_lo, s): its cells will be districts seat_lo+1 .. seat_lo+s. Numbering regions by seat_lo gives the
numbers of a depth-first traversal without doing one, so a nation of any number of states takes as many rounds as
the largest has halvings. Cells carry whether their east and south neighbours are of their region, so after the first
look no level joins cells with cells: people and parted neighbours are added up by key before the one shuffle of a
level, and a table of at most a row a seat goes back to the cells, which stay where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

REGION = ["state", "seat_lo", "s"]
CELL = ["state", "r", "c", "pop", "seat_lo", "s", "east", "south"]


def start(grid: DataFrame, seats: DataFrame) -> DataFrame:
    """Cells as one region a state. seats: (state, seats), a row a state."""
    beside = lambda line, along: F.count(F.lit(1)).over(Window.partitionBy("state", line).orderBy(along).rangeBetween(1, 1)) > 0
    marked = grid.withColumn("east", beside("r", "c")).withColumn("south", beside("c", "r"))
    return marked.join(F.broadcast(seats), "state").withColumn("seat_lo", F.lit(0)).withColumn("s", F.col("seats").cast("int")).select(*CELL)


def by_key(regions: DataFrame) -> DataFrame:
    """(state, seat_lo, s, fam, k, pop, cells, cut_len): people and cells of each key, and neighbours parted by a cut behind it.

    The four families are columns, rows and both diagonals. A pair of neighbours is parted behind the lower of its keys."""
    r, c, pop, east, south = (F.col(x) for x in ("r", "c", "pop", "east", "south"))
    one = lambda x: x.cast("long")
    key = lambda fam, k, people, n, parted: F.struct(F.lit(fam).alias("fam"), k.cast("int").alias("k"), people.alias("pop"), F.lit(n).alias("cells"), parted.alias("cut_len"))
    keys = F.array(
        key(0, c, pop, 1, one(east)), key(1, r, pop, 1, one(south)), key(2, r + c, pop, 1, one(east) + one(south)), key(3, r - c, pop, 1, one(south)),
        key(3, r - c - 1, F.lit(0).cast("long"), 0, one(east)),
    )
    rows = regions.where("s >= 2").withColumn("pop", pop.cast("long")).select(*REGION, F.explode(keys).alias("x")).select(*REGION, "x.*")
    summed = rows.groupBy(*REGION, "fam", "k").agg(F.sum("pop").cast("long").alias("pop"), F.sum("cells").alias("cells"), F.sum("cut_len").cast("long").alias("cut_len"))
    return summed.where("cells > 0")


def cut_candidates(regions: DataFrame) -> DataFrame:
    """(state, seat_lo, s, fam, t, err, cut_len) for every threshold that leaves cells on both sides.

    err: |population up to the threshold - share of the first half|; cut_len: neighbouring cells that it parts."""
    return _candidates(by_key(regions))


def _candidates(keys: DataFrame) -> DataFrame:
    family = Window.partitionBy(*REGION, "fam")
    upto = family.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prefix = keys.withColumn("prefix", F.sum("pop").over(upto)).withColumn("last", F.max("k").over(family)).withColumn("all", F.sum("pop").over(family))
    want = (F.floor(F.col("s") / 2) / F.col("s")) * F.col("all")
    return prefix.where("k < last").select(*REGION, "fam", F.col("k").alias("t"), F.abs(F.col("prefix") - want).alias("err"), "cut_len")


def best_cuts(candidates: DataFrame) -> DataFrame:
    """The least (err, cut_len, fam, t) of every region."""
    best = candidates.groupBy(*REGION).agg(F.min(F.struct("err", "cut_len", "fam", "t")).alias("b"))
    return best.select(*REGION, "b.*")


def _low(r: Column, c: Column) -> Column:
    """Whether a cell is on the first side of its region's cut."""
    fam = F.col("fam")
    return F.when(fam == 0, c).when(fam == 1, r).when(fam == 2, r + c).otherwise(r - c) <= F.col("t")


def level(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions one level down, the cuts made). Regions of one seat stay. A region of no more cells than seats gives one
    cell to each seat in the order of cells. One whose rows are all of one cell is parted in their order
    (split_in_order)."""
    keys = by_key(regions)
    size = keys.where("fam = 0").groupBy(*REGION).agg(F.sum("cells").alias("n"))
    # At most a row a seat of all states.
    plan = cut(size.join(best_cuts(_candidates(keys)), REGION, "left").withColumn("few", F.col("n") <= F.col("s")), "splitline-cuts")
    odd = plan.agg(F.bool_or("few").alias("few"), F.bool_or(F.expr("NOT few AND t IS NULL")).alias("uncut")).first()
    told = regions.join(F.broadcast(plan), REGION, "left")
    half = F.floor(F.col("s") / 2).cast("int")
    r, c = F.col("r"), F.col("c")
    stays = F.col("s") < 2
    low = _low(r, c)
    moved = told.where(stays | (~F.col("few") & F.col("t").isNotNull())).select(
        "state", "r", "c", "pop",
        F.when(stays | low, F.col("seat_lo")).otherwise(F.col("seat_lo") + half).cast("int").alias("seat_lo"),
        F.when(stays, F.col("s")).when(low, half).otherwise(F.col("s") - half).cast("int").alias("s"),
        F.when(stays, F.col("east")).otherwise(F.col("east") & (low == _low(r, c + 1))).alias("east"),
        F.when(stays, F.col("south")).otherwise(F.col("south") & (low == _low(r + 1, c))).alias("south"),
    )
    made = plan.where("not few and t is not null").select(*REGION, "err", "cut_len", "fam", "t")
    if odd["few"]:
        order = Window.partitionBy(*REGION).orderBy("r", "c", "pop")
        alone = F.lit(False)
        few = told.where("few").withColumn("k", F.row_number().over(order) - 1).select("state", "r", "c", "pop", (F.col("seat_lo") + F.col("k")).cast("int").alias("seat_lo"), F.lit(1).alias("s"), alone.alias("east"), alone.alias("south"))
        moved = moved.unionByName(few)
    if odd["uncut"]:
        moved = moved.unionByName(split_in_order(told.where("not few and t is null")))
    return moved, made


def split_in_order(regions: DataFrame) -> DataFrame:
    """Cells of regions parted where the running population first reaches the first half's share; both sides get a cell."""
    region = Window.partitionBy(*REGION)
    order = region.orderBy("r", "c", "pop")
    half = F.floor(F.col("s") / 2).cast("int")
    before = F.coalesce(F.sum("pop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (F.row_number().over(order) == 1) | ((before < (half / F.col("s")) * F.sum("pop").over(region)) & (F.row_number().over(order) < F.count(F.lit(1)).over(region)))
    parted = regions.withColumn("first", first)
    return parted.select(
        "state", "r", "c", "pop", F.when(F.col("first"), F.col("seat_lo")).otherwise(F.col("seat_lo") + half).cast("int").alias("seat_lo"),
        F.when(F.col("first"), half).otherwise(F.col("s") - half).cast("int").alias("s"), F.lit(False).alias("east"), F.lit(False).alias("south"),
    )


def splitline(grid: DataFrame, seats: DataFrame, most_seats: int, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, list[DataFrame]]:
    """((state, r, c, pop, district), the cuts of each level). most_seats: the largest number of seats, which sets the number
    of levels. keep: where each level is written, to end its lineage (see shared.cut of a cluster's folder)."""
    regions, cuts = start(grid, seats), []
    n = most_seats
    while n > 1:
        regions, made = level(regions)
        regions = keep(regions, "splitline")
        cuts.append(made)
        n = n - n // 2
    return regions.select("state", "r", "c", "pop", (F.col("seat_lo") + 1).cast("int").alias("district")), cuts


def anchors(assigned: DataFrame) -> DataFrame:
    """The first cell of each district in the order of cells."""
    return assigned.groupBy("state", "district").agg(F.min(F.struct("r", "c")).alias("a")).select("state", "district", "a.r", "a.c")
