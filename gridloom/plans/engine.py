"""Whole runs: from a grid to scored, ranked and verified maps, for any number of states, arms and vintages at once.

A run is a chain of DataFrames. State, arm and vintage are one key through all operators, so a nation of all arms is one job
after the other and not a loop over states. What fails for one key is a row of the ledger; the others go on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_albers
from ..operators import demography, graph, grid, kernels, metrics, orders, outline, raster, repair, splitline, verify, vintages
from ..sources import writers
from ..storage import cut

ARMS = ("accretion-west", "accretion-centroid", "splitline", "hilbert")
#: Arms that run only where they are asked for.
MORE_ARMS = ("centre-spiral",)
_BAR = "|"


def _keyed(df: DataFrame, *more: str) -> DataFrame:
    """One text key in place of state and further columns."""
    return df.withColumn("state", F.concat_ws(_BAR, "state", *more)).drop(*more)


def _split(df: DataFrame, *more: str) -> DataFrame:
    parts = F.split("state", rf"\{_BAR}")
    for i, name in enumerate(more, 1):
        df = df.withColumn(name, F.element_at(parts, i + 1))
    return df.withColumn("state", F.element_at(parts, 1))


@dataclass
class Run:
    """assigned: (state, arm, r, c, pop, district); stats: a row a district; scored: a row an arm, with its rank; ledger: (key, status, stage,
    error, cells, and what repair moved); sealed: pockets of accretion; bridges: between parts of a state."""

    assigned: DataFrame
    stats: DataFrame
    scored: DataFrame
    ledger: DataFrame
    sealed: DataFrame | None
    bridges: DataFrame


@dataclass
class Grid:
    """cells: (state, r, c, pop, blocks) of every in-state cell; extents: a row a state."""

    cells: DataFrame
    extents: DataFrame


def build_grid(blocks: DataFrame, rings: DataFrame | None = None, resident: DataFrame | None = None) -> Grid:
    """The grid of each state of blocks (state, geoid, pop, lon, lat). rings: outlines (state, ring_id, seq, x, y in degrees), without which
    only cells with a block are in a state. resident: (state, resident_pop), a row a state; where cells do not hold
    these people, the cells raise before a row is given."""
    x, y = to_albers(F.col("lon"), F.col("lat"))
    points = blocks.select("state", "geoid", "pop", x.alias("x"), y.alias("y"))
    extents = cut(grid.extent(points), "extents")
    cells = grid.cells(grid.bin_points(points, extents))
    if rings is not None:
        cells = outline.state_cells(cells, rings, extents)
    return Grid(cells if resident is None else grid.conserved(cells, resident), extents)


def assignments(cells: DataFrame, seats: DataFrame, most_seats: int, arms: tuple[str, ...] = ARMS, budget: float | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """((state, arm, r, c, pop, district) of every arm, not repaired; pockets of the accretion arms; (state, arm, error) of what failed)."""
    facts = cells.groupBy("state").agg(F.sum("pop").alias("p"), F.min("pop").alias("least")).join(F.broadcast(seats), "state")
    wrong = F.when(F.coalesce("seats", F.lit(0)) < 1, "ValueError: no seats").when(F.col("least") < 0, "ValueError: negative population of a cell")
    facts = cut(facts.select("state", "seats", (F.col("p") / F.greatest("seats", F.lit(1))).alias("ideal"), wrong.alias("error")), "run-facts")
    made, sealed, failed = [], [], []
    for arm in arms:
        own, pockets = None, None
        if arm == "splitline":
            # What the kernels find out state by state; regions of a state that cannot be cut are not started.
            fit = F.broadcast(facts.where("error IS NULL").select("state"))
            own = splitline.splitline(cells.join(fit, "state"), seats.join(fit, "state"), most_seats, cut)[0]
            lost = facts.where("error IS NOT NULL")
        elif arm in ("hilbert", "centre-spiral"):
            order = orders.hilbert_order(cells, orders.hilbert_sides(cells)) if arm == "hilbert" else orders.spiral_order(cells)
            whole = cut(kernels.cut_along_order(order, seats, errors=True), "run-ordered")
            own, lost = whole.where("error IS NULL"), whole.where("error IS NOT NULL")
        elif arm in ("accretion-west", "accretion-centroid"):
            order = orders.centre_order(cells) if arm.endswith("centroid") else orders.serpentine_order(cells, orders.band_width(cells, facts.select("state", "ideal")))
            whole = cut(kernels.grow_logged(order, seats, errors=True, budget=budget), "run-grown")
            own, lost, pockets = kernels.grown_of(whole), whole.where("error IS NOT NULL"), kernels.sealed_of(whole)
        else:
            raise ValueError(f"unknown arm {arm}")
        name = F.lit(arm).alias("arm")
        made.append(own.select("state", name, "r", "c", "pop", "district"))
        failed.append(lost.select("state", name, "error"))
        sealed += [pockets.withColumn("arm", F.lit(arm))] if pockets is not None else []
    union = lambda xs: reduce(DataFrame.unionByName, xs) if xs else None
    return union(made), union(sealed), union(failed)


_COUNTS = ("orphan_pieces", "orphan_cells", "rebalance_moves", "repair_moves")


def _told(repaired: DataFrame, failed: DataFrame) -> DataFrame:
    """The ledger rows of keys whose repair ended, and of keys that failed before (state, error)."""
    said = repaired.groupBy("state").agg(F.max("error").alias("error"), F.count("district").alias("cells"), *[F.max(c).cast("long").alias(c) for c in _COUNTS])
    said = said.withColumn("stage", F.lit("repair"))
    early = failed.select("state", "error", F.lit(0).cast("long").alias("cells"), *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit("assign").alias("stage"))
    both = said.unionByName(early)
    status = F.when(F.col("error").isNull(), "done").when(F.col("error").startswith("TimeoutError"), "timeout").otherwise("failed")
    return both.select(F.col("state").alias("key"), status.alias("status"), F.when(F.col("error").isNotNull(), F.col("stage")).alias("stage"), "error", "cells", *_COUNTS)


def run(cells: DataFrame, seats: DataFrame, most_seats: int, arms: tuple[str, ...] = ARMS, budget: float | None = None) -> Run:
    """cells: (state, r, c, pop), empty ones included (see build_grid); seats: (state, seats), a row a state; most_seats: the
    largest number of seats; budget: seconds that a kernel may take for a state and arm."""
    own = cut(cells.select(F.col("state").cast("string").alias("state"), "r", "c", F.col("pop").cast("long").alias("pop")), "run-cells")
    seats = seats.select(F.col("state").cast("string").alias("state"), "seats")
    bridges = cut(graph.bridges(graph.components(own)).drop("d2"), "run-bridges")
    raw, sealed, failed = assignments(own, seats, most_seats, arms, budget)
    names = own.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    each = lambda df: _keyed(df.crossJoin(F.broadcast(names)), "arm")  # noqa: E731  a few arms for each row a state
    repaired = cut(repair.repair_all(_keyed(raw, "arm"), each(seats), each(bridges), errors=True, budget=budget), "run-repaired")
    ledger = cut(_told(repaired, _keyed(failed, "arm")), "run-ledger")
    done = repaired.where("error is null").drop("error")
    ideal = done.groupBy("state").agg(F.sum("pop").alias("p")).join(each(seats), "state").select("state", (F.col("p") / F.col("seats")).alias("ideal"))
    assigned = done.select("state", "r", "c", "pop", "district")
    stats = cut(metrics.district_stats(assigned, ideal), "run-stats")
    pieces = graph.contiguity(graph.components(assigned, "district", bridges=each(bridges)))
    whole = metrics.contiguous_arms(_split(pieces, "arm"))
    moves = _split(ledger.where("status = 'done'").select(F.col("key").alias("state"), "repair_moves"), "arm")
    scored = metrics.rank_arms(metrics.scores(_split(stats, "arm"), seats, whole, moves))
    return Run(_split(assigned, "arm"), _split(stats, "arm"), scored, ledger, sealed, bridges)


@dataclass
class Vintages:
    """maps: (state, decade, r, c, pop, district); stats: a row a district; ledger: (key, status, error, cells, coverage, max_abs_dev_pct, irregular,
    sha256 and what repair moved); bridges: between parts of a state, by decade."""

    maps: DataFrame
    stats: DataFrame
    ledger: DataFrame
    bridges: DataFrame


def vintage_runs(cell_counties: DataFrame, county_pops: DataFrame, jobs: DataFrame, most_seats: int) -> Vintages:
    """The maps that jobs asks for, on the populations of each decade. Cells are those of the base census; their people change with their
    counties. Parts of a state that water divides are bridged, once for all decades: cells do not change.

    cell_counties: (state, r, c, county, pop); county_pops: (state, decade, county, pop); jobs: as from vintages.decade_jobs."""
    maps = jobs.where("kind = 'map'")
    wanted = F.broadcast(maps.select("state", "decade"))
    cells = _keyed(cell_counties.join(wanted, "state"), "decade")
    base = _keyed(cell_counties.groupBy("state", "county").agg(F.sum("pop").cast("long").alias("pop")).join(wanted, "state"), "decade")
    ratios = demography.county_ratios(base, _keyed(county_pops, "decade"))
    own = cut(demography.rescale(cells, ratios), "vintage-cells")
    links = graph.bridges(graph.components(cell_counties.groupBy("state", "r", "c").agg(F.sum("pop").alias("pop")))).drop("d2")
    bridges = cut(_keyed(links.join(wanted, "state"), "decade"), "vintage-bridges")
    seats = _keyed(maps.select("state", "decade", "seats"), "decade")
    made = splitline.splitline(own, seats, most_seats, cut)[0]
    repaired = cut(repair.repair_all(made, seats, bridges, errors=True), "vintage-repaired")
    done = repaired.where("error is null")
    ideal = done.groupBy("state").agg(F.sum("pop").alias("p")).join(seats, "state").select("state", (F.col("p") / F.col("seats")).alias("ideal"))
    stats = cut(metrics.district_stats(done.select("state", "r", "c", "pop", "district"), ideal), "vintage-stats")
    shape = stats.groupBy("state").agg(F.max(F.abs("deviation_pct")).alias("max_abs_dev_pct"), F.count_if("irregular").alias("irregular"))
    said = _told(repaired, made.limit(0).select("state", F.lit("").alias("error"))).withColumnRenamed("key", "state")
    said = said.join(demography.coverage(ratios), "state").join(shape, "state", "left").join(verify.fingerprint_stream(done), "state", "left")
    more = ("coverage", "max_abs_dev_pct", "irregular", "sha256", *_COUNTS)
    with_map = said.select(F.regexp_replace("state", rf"\{_BAR}", ":").alias("key"), "status", "error", "cells", *more)
    at_large = jobs.where("kind = 'at-large'").select("key", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("cells"), *[F.lit(None).cast(dict(with_map.dtypes)[c]).alias(c) for c in more])
    return Vintages(_split(done.select("state", "r", "c", "pop", "district"), "decade"), _split(stats, "decade"), with_map.unionByName(at_large), _split(bridges, "decade"))


def seat_preview(estimates: DataFrame, official: DataFrame, constants: DataFrame, total_seats: int) -> DataFrame:
    """(state, est, pct_change, seats, delta); raises before a row is given if a gate fails."""
    checked = vintages.require_all(vintages.preview_gates(estimates, official, constants, total_seats))
    passed = checked.agg(F.bool_and("ok").alias("passed"))  # one row
    return vintages.preview(estimates, constants, total_seats).crossJoin(F.broadcast(passed)).where("passed").drop("passed")


def verify_run(done: Run, resident: DataFrame, arms: tuple[str, ...] = ARMS, gate_pct: float = 2.0, flag_only: list[str] | None = None) -> DataFrame:
    """(state, arm, .., verdict): the population verifier over the arms asked for, from their assignments anew."""
    pick = lambda df: _keyed(df.where(F.col("arm").isin(*arms)), "arm")
    each = _keyed(resident.withColumn("state", F.col("state").cast("string")).join(done.assigned.select("state", "arm").distinct(), "state").where(F.col("arm").isin(*arms)), "arm")
    checked = _split(verify.population(pick(done.assigned), pick(done.stats), each), "arm")
    return verify.verdicts(checked, gate_pct, metrics.FLAGGED_ONLY if flag_only is None else flag_only)


def write_artifacts(done: Run, state: str, extents: DataFrame, folder: Path) -> list[Path]:
    """The files of one state: assignments, statistics, GeoJSON and pockets of every arm, and the scores. A map is gathered here, one arm at
    a time: it is one file by nature."""
    folder.mkdir(parents=True, exist_ok=True)
    out, hashes = [], {}
    counts = {r["key"]: r for r in done.ledger.where(F.col("key").startswith(f"{state}{_BAR}")).collect()}
    for row in done.scored.where(F.col("state") == state).orderBy("arm").collect():
        arm = row["arm"]
        own = done.assigned.where(F.col("arm") == arm)
        stats = done.stats.where(F.col("arm") == arm)
        paths = [folder / f"assign_{arm}.csv", folder / f"stats_{arm}.json", folder / f"districts_{arm}.geojson"]
        hashes[arm] = writers.write_assignment(own, state, str(paths[0]))
        told = counts[f"{state}{_BAR}{arm}"]
        moved = {"orphanComponentsMoved": told["orphan_pieces"], "orphanCellsMoved": told["orphan_cells"], "rebalanceMoves": told["rebalance_moves"]}
        writers.write_stats(stats, state, arm, moved, hashes[arm], str(paths[1]))
        writers.write_geojson(stats, raster.shapes(raster.dissolve(own), extents), state, str(paths[2]))
        if done.sealed is not None and arm.startswith("accretion"):
            paths.append(folder / f"sealed_{arm}.json")
            writers.write_sealed(done.sealed.where(F.col("arm") == arm), state, str(paths[-1]))
        out += paths
    sha = F.create_map(*[F.lit(x) for pair in hashes.items() for x in pair]) if hashes else F.create_map(F.lit(""), F.lit(""))
    writers.write_scores(done.scored.where(F.col("state") == state).withColumn("sha256", F.element_at(sha, F.col("arm"))), str(folder / "scores.csv"))
    return [*out, folder / "scores.csv"]


def write_maps(done: Run, state: str, extents: DataFrame, folder: Path, pixel: int = 4) -> list[Path]:
    """The pictures of one state: SVG, a page with a map, and a PNG of every arm. The PNG's strips are coded by tasks."""
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for row in done.scored.where(F.col("state") == state).select("arm").orderBy("arm").collect():
        arm = row["arm"]
        own = done.assigned.where((F.col("arm") == arm) & (F.col("state") == state))
        stats = done.stats.where((F.col("arm") == arm) & (F.col("state") == state))
        paths = [folder / f"map_{arm}.svg", folder / f"map_{arm}.html", folder / f"map_{arm}.png"]
        said = [{"district": r["district"], "pop": r["pop"], "deviationPct": r["deviation_pct"], "irregular": r["irregular"]} for r in stats.orderBy("district").toLocalIterator()]
        paths[0].write_text(writers.svg(((r[0], r[1], r[2]) for r in own.select("r", "c", "district").orderBy("r", "c").toLocalIterator()), said))
        shapes = raster.shapes(raster.dissolve(own), extents)
        paths[1].write_text(writers.leaflet(f"{state}: {arm}", writers.geojson(stats, shapes, state)))
        paths[2].write_bytes(writers.png_of(own.withColumnRenamed("district", "v"), pixel))
        out += paths
    return out
