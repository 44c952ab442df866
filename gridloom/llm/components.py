"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

FOREST = "u long, v long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    def flush():
        u, m = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(m)], ["u", "v"])
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
        held += len(x)
        if held > 2_000_000:  # memory of a task is bounded; what is left over meets in the star rounds
            yield flush()
            a, b, held = [], [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are not listed.

    edges: two long columns. Null ends and self-loops are ignored, edges may repeat and come either way.
    Each task contracts the edges that it holds to a forest, before and after they are shuffled; large-star and small-star
    rounds, contracted likewise, run until only stars are left. Every round is written to the shared checkpoint folder, in place of the round before."""
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.mapInArrow(_contract, FOREST).distinct().mapInArrow(_contract, FOREST), name)
    rounds = 0
    while not _only_stars(e):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError("components did not settle")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.where(F.col("u") != F.col("v")).distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.join(low, "u")
        both = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(both.mapInArrow(_contract, FOREST), name, instead_of=e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()


def _only_stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v), u > v, has one v that is no u itself: then v is its component."""
    ends = e.select(F.col("u").alias("x"), "v", F.lit(0).alias("root")).union(e.select("v", F.lit(None).cast("long"), F.lit(1)))
    return ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("root").alias("root")).where("lo < hi or (lo is not null and root = 1)").isEmpty()
