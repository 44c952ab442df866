"""Sequential algorithms: a step depends on all steps before it. Cuts along an order are searched by built-in functions; accretion
runs one state (and arm) at a time.

States, arms and vintages are independent groups. A state's grid is bounded (a cell a square mile), so a
group always fits a task. Neighbours are looked up in a dict of cells; every choice has a total order."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cell = tuple[int, int]
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


class Budget:
    """Seconds that one group may take; None is no limit. check() raises once they are over, and is cheap enough for inner loops."""

    def __init__(self, seconds: float | None = None):
        self.end = None if seconds is None else time.monotonic() + seconds
        self.calls = -1

    def check(self) -> None:
        self.calls += 1
        if self.end is not None and self.calls % 256 == 0 and time.monotonic() > self.end:
            raise TimeoutError("over the budget of a state")


def checked_state(pops: Iterable[int], seats: int | None) -> int:
    """The number of seats, if a state of these people can be cut at all."""
    if seats is None or pd.isna(seats) or int(seats) < 1:
        raise ValueError("no seats")
    if any(p < 0 for p in pops):
        raise ValueError("negative population of a cell")
    return int(seats)


def failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def closer(total: int, more: int, target: float) -> bool:
    """Whether a district takes the next cell: always while it is empty of people, else if that brings it no further from its target."""
    return total == 0 or abs(total + more - target) <= abs(total - target)


def accrete(pop: dict[Cell, int], seeds: Iterable[Cell], seats: int, budget: Budget | None = None) -> tuple[dict[Cell, int], list[Cell], list[tuple[int, int, str]]]:
    """(district of each cell, first cell of each district, sealed pockets as (district, population, reason)).

    A district grows from the next free seed by the free neighbour that keeps its box smallest, then is nearest to the
    seed (by rows and columns), then comes first. Walled in, it goes on from the next seed. Candidates wait in heaps by
    box side: growing the box changes the side of a candidate only upwards, so a stale entry is put back."""
    district: dict[Cell, int] = {}
    anchors: list[Cell] = []
    sealed: list[tuple[int, int, str]] = []
    budget = budget or Budget()
    order = iter(seeds)
    left = sum(pop.values())

    def next_seed() -> Cell | None:
        return next((s for s in order if s not in district), None)

    for d in range(1, seats + 1):
        target = left / (seats - d + 1)
        seed = next_seed()
        if seed is None:
            break
        anchors.append(seed)
        if d == seats:
            district |= {k: d for k in pop if k not in district}
            break
        total = 0
        heap: list[tuple[int, int, int, int]] = []
        waiting: set[Cell] = set()
        box = [seed[0], seed[0], seed[1], seed[1]]

        def side(r: int, c: int, box=box) -> int:
            return max(max(box[1], r) - min(box[0], r), max(box[3], c) - min(box[2], c)) + 1

        def take(cell: Cell, seed: Cell, d=d, heap=heap, waiting=waiting) -> None:
            district[cell] = d
            for dr, dc in STEPS:
                k = (cell[0] + dr, cell[1] + dc)
                if k in pop and k not in district and k not in waiting:
                    waiting.add(k)
                    heapq.heappush(heap, (side(*k), max(abs(k[0] - seed[0]), abs(k[1] - seed[1])), *k))

        total += pop[seed]
        take(seed, seed)
        while True:
            budget.check()
            if not heap:
                again = next_seed()
                sealed.append((d, total, "sealed-reseeded" if again else "sealed-exhausted"))
                if again is None:
                    break
                seed = again
                box[:] = [seed[0], seed[0], seed[1], seed[1]]
                waiting.clear()
                total += pop[seed]
                take(seed, seed)
                continue
            s, near, r, c = heap[0]
            now = side(r, c)
            if now != s:
                heapq.heapreplace(heap, (now, near, r, c))
                continue
            if not closer(total, pop[r, c], target):
                break
            heapq.heappop(heap)
            waiting.discard((r, c))
            total += pop[r, c]
            box[:] = [min(box[0], r), max(box[1], r), min(box[2], c), max(box[3], c)]
            take((r, c), seed)
        left -= total
    return district, anchors, sealed


# ---------------------------------------------------------------- DataFrames


def _by_state(ordered: DataFrame, seats: DataFrame, make: Callable[[pd.DataFrame, int], list[pd.DataFrame]], errors: bool, more: dict[str, str]) -> DataFrame:
    """make over each state's cells in their order. With errors, a state that fails is one row: its name and why."""
    kinds = dict(ordered.dtypes) | more
    names = ["state", "r", "c", "pop", "district", *more, *["error"] * errors]
    schema = ", ".join(f"{k} {'string' if k == 'error' else 'int' if k == 'district' else kinds[k]}" for k in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        try:
            parts = make(pdf, checked_state(pdf["pop"].tolist(), pdf["seats"].iloc[0]))
        except Exception as e:
            if not errors:
                raise
            parts = [pd.DataFrame([(pdf["state"].iloc[0], failure(e))], columns=["state", "error"])]
        return pd.concat([x.reindex(columns=names).astype(object) for x in parts]).astype(object).where(lambda x: x.notna(), None)

    own = ordered.join(seats, "state").select("state", "r", "c", "pop", "ord", "seats")
    return own.groupBy("state").applyInPandas(run, schema)


#: Cells in a chunk of an order.
CHUNK = 1024


def cut_along_order(ordered: DataFrame, seats: DataFrame, errors: bool = False) -> DataFrame:
    """(state, r, c, pop, district) of cells with ord, cut greedily: each district aims at an equal share of what is left and takes the next cell
    as in closer(), the last takes the rest. seats: (state, seats). With errors there is a column error, and a state that fails is one row with it.

    Built-in functions only, all states at once. People are summed in two levels: inside chunks of CHUNK cells of an order, then over the
    chunks of a state. With S the people before a cell of m people, P those before its district and k districts to fill, the district ends
    before the first such cell with m > 0, S > P and k * (2 * S + m - 2 * P) > 2 * (all - P). Both sides grow along the order, so
    a district's end is searched seat by seat, first among the chunks' last cells, then in one chunk. A state's peopled cells are one row: a
    cell a square mile with a block in it. The cells themselves take their districts from at most a start a seat."""
    own = ordered.join(F.broadcast(seats.select("state", F.col("seats").cast("int").alias("seats"))), "state").select("state", "r", "c", "pop", F.col("ord").cast("long").alias("ord"), "seats")
    keyed = own.select("state", "ord", F.col("pop").cast("long").alias("m"), "seats", F.floor(F.col("ord") / CHUNK).alias("chunk"))
    upto = Window.partitionBy("state", "chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("upto", F.sum("m").over(upto))
    cell = F.when(F.col("m") > 0, F.struct("ord", (F.col("upto") - F.col("m")).alias("s"), "m"))
    chunks = summed.groupBy("state", "chunk").agg(F.sum("m").alias("people"), F.min("m").alias("least"), F.max("seats").alias("seats"), F.array_sort(F.collect_list(cell)).alias("cells"))
    before = Window.partitionBy("state").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("base", F.sum("people").over(before) - F.col("people"))
    peopled = F.when(F.size("cells") > 0, F.struct("chunk", "base", "cells"))
    states = chunks.groupBy("state").agg(F.sum("people").alias("all"), F.min("least").alias("least"), F.max("seats").alias("seats"), F.array_sort(F.collect_list(peopled)).alias("chunks"))
    wrong = F.when(F.coalesce("seats", F.lit(0)) < 1, "ValueError: no seats").when(F.col("least") < 0, "ValueError: negative population of a cell")
    states = states.withColumn("error", wrong)

    def next_start(acc: Column, k: Column) -> Column:
        def over(base: Column, x: Column) -> Column:
            s = base + x["s"] - acc["p"]
            return (s > 0) & (k * (2 * s + x["m"]) > 2 * (F.col("all") - acc["p"]))

        chunk = F.slice(F.filter("chunks", lambda g: over(g["base"], F.element_at(g["cells"], -1))), 1, 1)
        first = F.transform(chunk, lambda g: F.get(F.transform(F.slice(F.filter(g["cells"], lambda x: over(g["base"], x)), 1, 1), lambda x: F.struct((g["base"] + x["s"]).alias("p"), x["ord"].alias("ord"))), F.lit(0)))
        return F.get(F.transform(F.slice(F.concat(first, F.array(F.struct(F.col("all").alias("p"), F.lit(None).cast("long").alias("ord")))), 1, 1), lambda f: F.struct(f["p"].alias("p"), F.concat(acc["starts"], F.filter(F.array(f["ord"]), lambda x: x.isNotNull())).alias("starts"))), F.lit(0))

    some = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<long>").alias("starts"))
    left = F.when(F.col("error").isNull() & (F.col("seats") > 1), F.sequence(F.col("seats"), F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # At most a start a seat.
    starts = states.select("state", "error", F.aggregate(left, some, next_start)["starts"].alias("starts"))
    told = own.join(F.broadcast(starts), "state")
    district = (F.size(F.filter("starts", lambda x: x <= F.col("ord"))) + 1).cast("int")
    if not errors:
        checked = F.when(F.col("error").isNull(), district).otherwise(F.raise_error(F.concat_ws(": ", F.col("state").cast("string"), "error")).cast("int"))
        return told.select("state", "r", "c", "pop", checked.alias("district"))
    kinds = dict(ordered.dtypes)
    lost = starts.where("error IS NOT NULL").select("state", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("r", "c", "pop")], F.lit(None).cast("int").alias("district"), "error")
    return told.where("error IS NULL").select("state", "r", "c", "pop", district.alias("district"), "error").unionByName(lost)


def grow_logged(ordered: DataFrame, seats: DataFrame, errors: bool = False, budget: float | None = None) -> DataFrame:
    """Accretion from seeds in the order ord, in one pass: a row a cell (state, r, c, pop, district), a row a sealed pocket
    (state, district, n, pocket_pop, reason; see sealed_of), and, with errors, a row a state that fails (state, error). budget: seconds a state."""

    def make(pdf: pd.DataFrame, n: int) -> list[pd.DataFrame]:
        keys = list(zip(pdf["r"].tolist(), pdf["c"].tolist(), strict=True))
        district, _, sealed = accrete(dict(zip(keys, pdf["pop"].tolist(), strict=True)), keys, n, Budget(budget))
        pockets = pd.DataFrame([(pdf["state"].iloc[0], k, *x) for k, x in enumerate(sealed)], columns=["state", "n", "district", "pocket_pop", "reason"])
        return [pdf.assign(district=[district[k] for k in keys]), *[pockets] * bool(sealed)]

    return _by_state(ordered, seats, make, errors, {"n": "int", "pocket_pop": "long", "reason": "string"})


def grown_of(logged: DataFrame) -> DataFrame:
    """The cells of grow_logged."""
    return logged.where("r is not null").select("state", "r", "c", "pop", "district")


def sealed_of(logged: DataFrame) -> DataFrame:
    """(state, n, district, pop, reason): the pockets of grow_logged, in order; no rows for a state without any."""
    return logged.where("reason is not null").select("state", "n", "district", F.col("pocket_pop").alias("pop"), "reason")


def grow(ordered: DataFrame, seats: DataFrame) -> DataFrame:
    """(state, r, c, pop, district) by accretion from seeds in the order ord."""
    return grown_of(grow_logged(ordered, seats))
