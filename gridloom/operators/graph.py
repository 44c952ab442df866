"""Connected components of cells, and the bridges that join them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .grid import boundary


def bridge_edges(bridges: DataFrame) -> DataFrame:
    """Bridges as edges both ways."""
    there = bridges.select("state", F.col("ar").alias("r"), F.col("ac").alias("c"), F.col("br").alias("nr"), F.col("bc").alias("nc"))
    return there.union(there.select("state", "nr", "nc", "r", "c"))


def _contracted(on: list[str], most: int = 1_000_000) -> Callable:
    """Of a task's links the same components with one link a node: to the first node that the task's own links reach. At most `most`
    rows are held at once; what they leave apart meets in the rounds."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        ends = pd.concat([pdf[[*on, f"{k}r", f"{k}c"]].set_axis([*on, "r", "c"], axis=1) for k in "xy"], ignore_index=True)
        number = ends.groupby([*on, "r", "c"], sort=True).ngroup().to_numpy()
        x, y = number[: len(pdf)], number[len(pdf) :]
        first = np.arange(number.max() + 1)
        while True:
            low = np.minimum(first[x], first[y])
            new = first.copy()
            np.minimum.at(new, first[x], low)
            np.minimum.at(new, first[y], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == first).all():
                break
            first = new
        nodes = ends.assign(n=number).drop_duplicates("n").sort_values("n").reset_index(drop=True)
        moved = np.flatnonzero(first != np.arange(len(first)))
        to = nodes.loc[first[moved], ["r", "c"]].to_numpy()
        return nodes.loc[moved, [*on, "r", "c"]].rename(columns={"r": "xr", "c": "xc"}).assign(yr=to[:, 0], yc=to[:, 1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                rows += len(pdf)
            if rows > most:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def components(grid: DataFrame, *keys: str, bridges: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """(state, keys.., r, c, pop, comp_r, comp_c): the first cell of each cell's component; with keys, components of
    cells of equal keys (a district, say).

    Horizontal runs of cells are found first by one window, so that labels move by runs and not by cells; each task then
    contracts the links between runs that it holds, so that few rounds are left. Each
    round takes the least label of the neighbouring runs and of the label's own label. Rounds are
    written to the shared folder; they end when no label changes."""
    on = ["state", *keys]
    row = Window.partitionBy(*on, "r").orderBy("c")
    new = F.when(F.col("c") - F.lag("c").over(row) == 1, 0).otherwise(1)
    run = grid.select(*on, "r", "c", "pop").withColumn("new", new).withColumn("run", F.sum("new").over(row))
    run = run.withColumn("run_c", F.min("c").over(Window.partitionBy(*on, "r", "run"))).drop("new", "run")
    run = cut(run, "runs")
    # The run of the cell above: one window, no join of cells with cells.
    here = F.struct("r", F.col("run_c").alias("c"))
    above = F.lag(here).over(Window.partitionBy(*on, "c").orderBy("r"))
    pairs = run.select(*on, above.alias("x"), here.alias("y")).where("x.r = y.r - 1")
    if bridges is not None:
        ends = run.select(*on, "r", "c", here.alias("x"))
        far = run.select(*on, F.col("r").alias("nr"), F.col("c").alias("nc"), here.alias("y"))
        over = ends.join(bridge_edges(bridges), ["state", "r", "c"]).join(far, [*on, "nr", "nc"])
        pairs = pairs.unionByName(over.where("x < y").select(*on, "x", "y"))
    pairs = pairs.select(*on, F.col("x.r").alias("xr"), F.col("x.c").alias("xc"), F.col("y.r").alias("yr"), F.col("y.c").alias("yc"))
    short = pairs.mapInPandas(_contracted(on), pairs.schema).distinct()
    there = short.select(*on, F.struct(F.col("xr").alias("r"), F.col("xc").alias("c")).alias("x"), F.struct(F.col("yr").alias("r"), F.col("yc").alias("c")).alias("y"))
    links = cut(there.union(there.select(*on, F.col("y").alias("x"), F.col("x").alias("y"))), "run-links")
    labels = run.select(*on, F.struct("r", F.col("run_c").alias("c")).alias("x")).distinct().withColumn("label", F.col("x"))
    labels = now = cut(labels, "labels")
    for _ in range(most_rounds):
        other = labels.select(*on, F.col("x").alias("y"), F.col("label").alias("theirs"))
        near = links.join(other, [*on, "y"]).groupBy(*on, "x").agg(F.min("theirs").alias("near"))
        stepped = labels.join(near, [*on, "x"], "left").select(*on, "x", "label", F.coalesce(F.least("label", "near"), F.col("label")).alias("step"))
        above = labels.select(*on, F.col("x").alias("step"), F.col("label").alias("above"))
        now = cut(stepped.join(above, [*on, "step"]).select(*on, "x", F.least("step", "above").alias("label"), (F.least("step", "above") < F.col("label")).alias("moved")), "labels", instead_of=now)
        labels = now.drop("moved")
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = run.withColumn("x", F.struct("r", F.col("run_c").alias("c"))).join(labels, [*on, "x"])
    return out.select(*on, "r", "c", "pop", F.col("label.r").alias("comp_r"), F.col("label.c").alias("comp_c"))


def component_sizes(labelled: DataFrame, *keys: str) -> DataFrame:
    return labelled.groupBy("state", *keys, "comp_r", "comp_c").agg(F.count(F.lit(1)).alias("cells"), F.sum("pop").cast("long").alias("pop"))


def contiguity(labelled: DataFrame) -> DataFrame:
    """(state, district, pieces, ok) of cells labelled within their districts."""
    n = labelled.select("state", "district", "comp_r", "comp_c").distinct().groupBy("state", "district").agg(F.count(F.lit(1)).alias("pieces"))
    return n.withColumn("ok", F.col("pieces") == 1)


def _blocks(cells: DataFrame, on: list[str], side: int, above: int, name: str) -> DataFrame:
    """Blocks of side by side cells, each with the box of its cells and the block of side above that it is in. Columns begin with name: r, c, r0,
    r1, c0, c1, and the block above as u, v."""
    box = cells.groupBy(*on, F.floor(F.col("r") / side).alias(f"{name}r"), F.floor(F.col("c") / side).alias(f"{name}c"))
    box = box.agg(*[f(x).cast("long").alias(f"{name}{x}{i}") for x in "rc" for i, f in enumerate((F.min, F.max))])
    return box.withColumn(f"{name}u", F.floor(F.col(f"{name}r0") / above)).withColumn(f"{name}v", F.floor(F.col(f"{name}c0") / above))


def bridges(labelled: DataFrame) -> DataFrame:
    """(state, ar, ac, br, bc, d2): from each minor component to the main one (most cells, ties by first cell) the pair of
    boundary cells of least squared distance, ties by (ar, ac, br, bc).

    Looked for in blocks of cells, from coarse to fine. Of a minor component's pairs of blocks those stay whose boxes may be as near as its
    nearest pair is at the most; only these are taken apart into pairs of finer blocks, at last of cells. What is compared grows with the
    cells that face the main component, not with the product of both."""
    comp, kind = ["state", "comp_r", "comp_c"], dict(labelled.dtypes)["r"]
    first = component_sizes(labelled).groupBy("state").agg(F.min(F.struct(-F.col("cells"), "comp_r", "comp_c")).alias("m"))
    # A row a state.
    main = F.broadcast(first.select("state", "m.comp_r", "m.comp_c", F.lit(True).alias("main")))
    edge = boundary(labelled).select("state", "r", "c").join(labelled.select(*comp, "r", "c"), ["state", "r", "c"]).join(main, comp, "left")
    edge = cut(edge.select(*comp, "r", "c", F.coalesce("main", F.lit(False)).alias("main")), "bridge-edge")
    minor, main = edge.where("not main"), edge.where("main")
    wide = edge.groupBy("state").agg(F.greatest(F.max("r") - F.min("r"), F.max("c") - F.min("c")).alias("n")).agg(F.max("n")).first()[0] or 0
    sides = [1]
    while sides[-1] * 8 < wide:
        sides.append(sides[-1] * (4 if len(sides) < 3 else 8))
    far = lambda x: F.greatest(F.col(f"a{x}1") - F.col(f"b{x}0"), F.col(f"b{x}1") - F.col(f"a{x}0"))
    gap = lambda x: F.greatest(F.lit(0).cast("long"), F.col(f"a{x}0") - F.col(f"b{x}1"), F.col(f"b{x}0") - F.col(f"a{x}1"))
    kept = None
    for side, above in zip(sides[::-1], [sides[-1], *sides[:0:-1]], strict=True):
        a, b = _blocks(minor, comp, side, above, "a"), _blocks(main, ["state"], side, above, "b")
        # Of the coarsest a state has at most 81.
        pair = a.join(F.broadcast(b), "state") if kept is None else kept.join(a, [*comp, "au", "av"]).join(b, ["state", "bu", "bv"])
        pair = pair.select(*comp, "ar", "ac", "br", "bc", *[(f("r") * f("r") + f("c") * f("c")).alias(k) for k, f in (("least", gap), ("most", far))])
        if side > 1:
            bound = pair.groupBy(*comp).agg(F.min("most").alias("bound"))
            stay = pair.join(bound, comp).where("least <= bound")
            kept = cut(stay.select(*comp, *[F.col(x).alias(y) for x, y in (("ar", "au"), ("ac", "av"), ("br", "bu"), ("bc", "bv"))]), "bridge-blocks", instead_of=kept)
    best = pair.groupBy(*comp).agg(F.min(F.struct(F.col("least").alias("d2"), "ar", "ac", "br", "bc")).alias("b"))
    return best.select("state", *[F.col(f"b.{x}").cast(kind).alias(x) for x in ("ar", "ac", "br", "bc", "d2")])
