"""District statistics, scores, ranking and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import deviation_pct, irregular, ppn
from .grid import neighbour_edges

# The population gate in percent, and the states whose larger deviation is flagged and not failed.
GATE_DEFAULT, GATE_STRICT = 2.0, {"CO": 1.0}
FLAGGED_ONLY = ["NY", "CA", "IL", "NJ"]


def district_stats(assigned: DataFrame, ideal: DataFrame) -> DataFrame:
    """One row a district. assigned: (state, r, c, pop, district); ideal: (state, ideal), a row a state."""
    # Neighbours of the same district to the east and south, each seen from both sides.
    beside = lambda line, along: F.count(F.lit(1)).over(Window.partitionBy("state", "district", line).orderBy(along).rangeBetween(1, 1))
    d = assigned.withColumn("beside", beside("r", "c")).withColumn("beside", F.col("beside") + beside("c", "r")).groupBy("state", "district").agg(
        F.sum("pop").cast("long").alias("pop"), F.count(F.lit(1)).alias("cells"),
        (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"), (4 * F.count(F.lit(1)) - 2 * F.sum("beside")).alias("exposed"),
    )
    d = d.join(F.broadcast(ideal), "state")
    d = d.withColumn("deviation_pct", deviation_pct(F.col("pop"), F.col("ideal"))).withColumn("ppn", ppn(F.col("cells"), F.col("exposed")))
    d = d.withColumn("aspect", F.greatest("w", "h") / F.least("w", "h")).withColumn("fill", F.col("cells") / (F.col("w") * F.col("h")))
    return d.select("state", "district", "pop", "cells", "exposed", "deviation_pct", "ppn", "aspect", "fill", irregular(F.col("ppn"), F.col("aspect"), F.col("fill")).alias("irregular"))


def gate_pct(state: Column) -> Column:
    out = F.lit(GATE_DEFAULT)
    for k, v in GATE_STRICT.items():
        out = F.when(state == k, F.lit(v)).otherwise(out)
    return out


def population_verdict(state: Column, max_dev: Column) -> Column:
    """pass, flag or fail by the state's gate."""
    return F.when(max_dev <= gate_pct(state), "pass").when(state.isin(FLAGGED_ONLY), "flag").otherwise("fail")


def contiguous_arms(pieces: DataFrame) -> DataFrame:
    """(state, arm, contiguous): whether every district of an arm is in one piece. pieces: (state, arm, district, pieces)."""
    return pieces.groupBy("state", "arm").agg((F.max("pieces") == 1).alias("contiguous"))


def detached(labelled: DataFrame) -> DataFrame:
    """(state, cells, whole): how many cells are outside of their district's main piece (of most people, then cells, then the first), and
    whether there are none. labelled: cells with the components of their districts."""
    sizes = labelled.groupBy("state", "district", "comp_r", "comp_c").agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("p"))
    w = Window.partitionBy("state", "district").orderBy(F.col("p").desc(), F.col("n").desc(), "comp_r", "comp_c")
    k = sizes.withColumn("k", F.row_number().over(w))
    return k.groupBy("state").agg(F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).cast("long").alias("cells"), (F.max("k") == 1).alias("whole"))


def scores(stats: DataFrame, seats: DataFrame, contiguous: DataFrame, moves: DataFrame) -> DataFrame:
    """One row per (state, arm): extremes, counts, each gate of its own, and whether the arm is eligible. A deviation beyond the
    gate is flagged and does not fail in states of FLAGGED_ONLY. An arm that contiguous or moves lacks is not contiguous, or
    has no moves. stats: district statistics with an arm column; contiguous: (state, arm, contiguous); moves: (state, arm, repair_moves)."""
    s = stats.groupBy("state", "arm").agg(
        F.max(F.abs("deviation_pct")).alias("max_abs_dev_pct"), F.avg(F.abs("deviation_pct")).alias("mean_abs_dev_pct"),
        F.count_if("irregular").cast("int").alias("irregular_count"), F.avg("ppn").alias("mean_ppn"), F.count(F.lit(1)).cast("int").alias("districts"),
    )
    s = s.join(F.broadcast(seats), "state").join(contiguous, ["state", "arm"], "left").join(moves, ["state", "arm"], "left")
    s = s.withColumn("g1_population", population_verdict(F.col("state"), F.col("max_abs_dev_pct")))
    s = s.withColumn("g2_contiguity", F.coalesce("contiguous", F.lit(False))).withColumn("g4_coverage", F.col("districts") == F.col("seats"))
    s = s.withColumn("eligible", (F.col("g1_population") != "fail") & F.col("g2_contiguity") & F.col("g4_coverage"))
    said = F.array_compact(F.array(
        F.when(F.col("g1_population") == "fail", "G1-population").when(F.col("g1_population") == "flag", "G1-flagged-not-failed"),
        F.when(~F.col("g2_contiguity"), "G2-contiguity"), F.when(~F.col("g4_coverage"), "G4-coverage"),
    ))
    s = s.withColumn("gate_failures", F.when(F.size(said) == 0, "none").otherwise(F.array_join(said, "+")))
    return s.withColumn("repair_moves", F.coalesce("repair_moves", F.lit(0)).cast("long")).drop("seats", "contiguous")


def rank_arms(scored: DataFrame) -> DataFrame:
    """arm_rank within a state: eligible first, fewer irregular, higher mean ppn, fewer moves, smaller deviation, then name."""
    w = Window.partitionBy("state").orderBy(F.col("eligible").desc(), "irregular_count", F.col("mean_ppn").desc(), "repair_moves", "max_abs_dev_pct", "arm")
    return scored.withColumn("arm_rank", F.row_number().over(w).cast("long"))


def district_adjacency(assigned: DataFrame) -> DataFrame:
    """(state, district, other) for districts that touch, both ways."""
    e = neighbour_edges(assigned.select("state", "r", "c"))
    a = assigned.select("state", "r", "c", "district")
    b = assigned.select("state", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("district").alias("other"))
    return e.join(a, ["state", "r", "c"]).join(b, ["state", "nr", "nc"]).where("district <> other").select("state", "district", "other").distinct()


def neediest_neighbour(adjacency: DataFrame, pops: DataFrame) -> DataFrame:
    """(state, district, target): the adjacent district of least population, ties by number."""
    other = pops.select("state", F.col("district").alias("other"), F.col("pop").alias("other_pop"))
    return adjacency.join(other, ["state", "other"]).groupBy("state", "district").agg(F.min(F.struct("other_pop", "other")).alias("m")).select("state", "district", F.col("m.other").alias("target"))
