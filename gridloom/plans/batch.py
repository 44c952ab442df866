"""A nation in one batch: each state from its blocks to a verified map, what fails as a row, what is done not done again."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import demography, graph, grid, metrics, verify
from ..storage import cut
from . import engine
from .ledger import Ledger

#: Seconds that a state may take, and states whose maps are always looked at.
BUDGET_S = 1800.0
HARD = ("AK", "HI", "NY", "CA", "IL", "NJ")
ENTRY = (
    "key string, status string, stage string, error string, seats int, at_large boolean, eligible boolean, gate_failures string, max_abs_dev_pct double, "
    "irregular_count int, mean_ppn double, repair_moves long, sha256 string, v_pop boolean, v_cov boolean, v_cont boolean, flagged boolean"
)


def worklist(dim: DataFrame, ledger: Ledger, only: list[str] | None = None, force: bool = False) -> DataFrame:
    """The states of dim (state, seats, resident_pop) that a batch has to do: those asked for whose latest entry is not done."""
    jobs = dim.select(F.col("state").cast("string").alias("key"), F.col("seats").cast("int").alias("seats"), F.col("resident_pop").cast("long").alias("resident_pop"))
    if only is not None:
        jobs = jobs.where(F.col("key").isin(*only))
    return jobs if force else demography.worklist(jobs, ledger.entries().select("key", "status", "at"))


def run_batch(blocks: DataFrame, rings: DataFrame | None, dim: DataFrame, ledger: Ledger, arm: str = "splitline", only: list[str] | None = None, force: bool = False, budget: float = BUDGET_S) -> DataFrame:
    """The entries that this batch appended to the ledger, a row a state of the work-list.

    Stages: jobs (a published population is known), grid (its cells hold these people), assign and repair (the arm's map), then
    scores and three verifiers over the map. A state that fails at a stage is a row with the stage and why, over budget (seconds a state) with
    status timeout, and the others go on. A verifier's verdict is told and fails nothing. A state of one seat is done without a grid.
    blocks: (state, geoid, pop, lon, lat); rings: outlines, or None; dim: (state, seats, resident_pop), a row a state."""
    began = time.monotonic()
    todo = cut(worklist(dim, ledger, only, force), "batch-jobs")
    unknown = todo.where("resident_pop IS NULL").select("key", "seats", F.lit("failed").alias("status"), F.lit("jobs").alias("stage"), F.concat(F.lit("no verified population of "), "key").alias("error"))
    at_large = todo.where("resident_pop IS NOT NULL AND seats = 1").select("key", "seats", F.lit("done").alias("status"), F.lit(True).alias("at_large"), F.lit(True).alias("eligible"), F.lit("none").alias("gate_failures"))
    gridded = todo.where("resident_pop IS NOT NULL AND coalesce(seats, 0) <> 1").select(F.col("key").alias("state"), "seats", "resident_pop")
    parts = [unknown, at_large]
    if not gridded.isEmpty():
        parts += _mapped(blocks, rings, gridded, arm, began + budget)
    none = F.lit(None)
    kinds = dict(x.split() for x in ENTRY.split(", "))
    full = lambda df: df.select(*[(F.col(c) if c in df.columns else none).cast(k).alias(c) for c, k in kinds.items()])
    every = reduce(DataFrame.unionByName, [full(x) for x in parts])
    wrong = (F.col("status") != "done") | F.col("key").isin(*HARD) | ~F.coalesce("eligible", F.lit(True)) | (F.coalesce("gate_failures", F.lit("none")) != "none")
    every = every.withColumn("at_large", F.coalesce("at_large", F.lit(False))).withColumn("flagged", wrong)
    n = ledger.append(every)
    return ledger.entries().where(F.col("at") == n)


def _mapped(blocks: DataFrame, rings: DataFrame | None, gridded: DataFrame, arm: str, end: float) -> list[DataFrame]:
    """The entries of states that need a grid: those whose people do not add up stay behind, their numbers said; the others are cut, repaired and
    verified."""
    own = blocks.withColumn("state", F.col("state").cast("string")).join(F.broadcast(gridded.select("state")), "state", "left_semi")
    lines = None if rings is None else rings.withColumn("state", F.col("state").cast("string")).join(F.broadcast(gridded.select("state")), "state", "left_semi")
    cells = cut(engine.build_grid(own, lines).cells.select("state", "r", "c", "pop"), "batch-cells")
    gate = cut(grid.conservation(cells, gridded.select("state", "resident_pop")), "batch-gate")
    said = F.concat(F.lit("people of the cells: "), F.col("pop").cast("string"), F.lit(", published: "), F.col("resident_pop").cast("string"))
    broken = gate.where("NOT ok").join(gridded.select("state", "seats"), "state").select(F.col("state").alias("key"), "seats", F.lit("failed").alias("status"), F.lit("grid").alias("stage"), said.alias("error"))
    sound = gridded.join(gate.where("ok").select("state"), "state", "left_semi")
    most = sound.agg(F.max("seats")).first()[0] or 1
    done = engine.run(cells.join(F.broadcast(sound.select("state")), "state", "left_semi"), sound.select("state", "seats"), max(most, 1), (arm,), budget=end - time.monotonic())
    told = done.ledger.select(F.split("key", r"\|")[0].alias("state"), "status", "stage", "error").join(sound.select("state", "seats"), "state")
    entries = told.join(_outcome(done, cells, sound), "state", "left").withColumnRenamed("state", "key")
    return [broken, entries]


def _outcome(done: engine.Run, cells: DataFrame, sound: DataFrame) -> DataFrame:
    """A row a state whose map is there: its scores, its hash, and what the verifiers say of the map itself."""
    assigned, stats = done.assigned, done.stats
    scores = done.scored.select("state", "eligible", "gate_failures", "max_abs_dev_pct", "irregular_count", "mean_ppn", "repair_moves")
    checked = verify.verdicts(verify.population(assigned, stats, sound.select("state", "resident_pop").join(assigned.select("state").distinct(), "state", "left_semi")), flag_only=metrics.FLAGGED_ONLY)
    expected = cells.join(F.broadcast(sound.select("state")), "state", "left_semi")
    holes = verify.missing_cells(expected, assigned).unionByName(verify.extra_cells(expected, assigned)).unionByName(verify.duplicate_cells(assigned).select("state", "r", "c"))
    uncovered = holes.select("state").unionByName(verify.empty_districts(assigned, sound.select("state", "seats")).select("state")).distinct().withColumn("hole", F.lit(True))
    pieces = graph.contiguity(graph.components(assigned, "district", bridges=done.bridges)).groupBy("state").agg(F.bool_and("ok").alias("v_cont"))
    out = scores.join(checked.select("state", (F.col("verdict") != "fail").alias("v_pop")), "state").join(uncovered, "state", "left").join(pieces, "state", "left")
    return out.join(verify.fingerprint_stream(assigned), "state").withColumn("v_cov", F.col("hole").isNull()).drop("hole")
