"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2t) of each other. A rotation to the principal
directions keeps all distances; cells of width epsilon on the leading ones give every vector a grid
cell, and the vectors are sorted by their cells (the epsilon grid order). The order is cut into intervals, which are
written once. Intervals whose boxes are nearer than epsilon meet by a product of the written files: each task reads the intervals it
joins, and no vector is shuffled for the others it meets. Two intervals are joined by halving both as long as the boxes around their
vectors are nearer than epsilon: blocks provably apart are skipped. In small blocks the leading directions rule out in single
precision what is provably farther than epsilon; the rest is compared whole, in double precision.

Equal vectors are joined as one with their number; they are found by digests, so vectors move only to be sorted. Links are counted for
each vector where they are found, and only a spanning forest of each batch of pairs of intervals goes on to the components: links are
never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components, forest
from .shared import cut, released

#: Vectors in an interval, which is a unit of work in memory, and in a block compared at once; directions in a cell.
INTERVAL, LEAF, CELLS = 4096, 512, 12
#: Intervals in a file and kept by a task that joins them; directions that screen a block in single precision, with its rounding.
TOGETHER, SCREEN, ROUNDING = 12, 24, 1e-5
SLACK = 1e-6


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors that are not zero at length 1: divided by the largest component first, so that lengths neither overflow nor vanish."""
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def linkable(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length of vector: the rows whose vector can link, and these vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0).to_pylist(), np.int64)
    flat = column.flatten()
    holes = np.asarray(flat.is_null())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows: list[np.ndarray] = []
    out: list[np.ndarray] = []
    for d in np.unique(sizes):
        if d == 0:
            continue
        own = np.flatnonzero(sizes == d)
        v = values[at[own][:, None] + np.arange(d)]
        bad = holes[at[own][:, None] + np.arange(d)].any(1) | ~np.isfinite(v).all(1)
        good = ~bad & v.any(1)
        rows.append(own[good])
        out.append(v[good])
    return rows, out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension the number, sum and product sums of a task's vectors."""
    total: dict[int, list] = {}
    for batch in batches:
        for v in map(scaled, linkable(batch.column(1))[1]):
            n = total.setdefault(v.shape[1], [0, np.zeros(v.shape[1]), np.zeros((v.shape[1],) * 2)])
            n[0] += len(v)
            n[1] += v.sum(0)
            n[2] += v.T @ v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.concatenate([[n], s, p.ravel()]).tobytes() for n, s, p in total.values()], pa.binary())], ["dim", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[d] = total.get(d, 0) + np.frombuffer(raw)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["dim", "sums"])


def principal(sums: np.ndarray, dim: int) -> np.ndarray:
    n, s, p = sums[0], sums[1 : dim + 1], sums[dim + 1 :].reshape(dim, dim)
    return np.linalg.eigh(p / n - np.outer(s / n, s / n))[1][:, ::-1]


def _cells(rotations: dict[int, np.ndarray], epsilon: float, kind: str) -> Callable:
    """(vec_id, dim, cells as sortable bytes, digest of the vector at length 1, the vector as given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, given in zip(*linkable(batch.column(1)), strict=True):
                if not len(rows):
                    continue
                v, d = scaled(given), given.shape[1]
                # Summed one component after the other: equal vectors get equal cells, whatever batch they are in.
                turned = np.zeros((len(v), min(d, CELLS)))
                for j in range(d):
                    turned += v[:, j, None] * rotations[d][j, :CELLS]
                cell = (np.floor(turned / epsilon) + 128 + 2.0 / epsilon).clip(0, 65535).astype(">u2")
                key = [blake2b(x.tobytes(), digest_size=16).digest() for x in v + 0.0]  # -0.0 equals 0.0
                columns = [[x.tobytes() for x in cell], key, [x.tobytes() for x in given.astype(kind)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), *(pa.array(x, pa.binary()) for x in columns)], ["vec_id", "dim", "cell", "key", "vector"])

    return released(run)


# ---------------------------------------------------------------- joining two intervals


class Part:
    """Vectors in grid order with the boxes around runs of them, halved again and again."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        self.ids, self.copies, self.v = ids, copies, scaled(vectors)
        self.t = self.v @ rotation
        # x.y - x.x/2 - y.y/2, over the leading directions, as one product of two rows: -1/2 of their squared distance.
        lead, one = self.t[:, :SCREEN], np.ones((len(ids), 1))
        half = -0.5 * (lead * lead).sum(1)[:, None]
        self.left, self.right = np.hstack([lead, half, one]).astype(np.float32), np.hstack([lead, one, half]).astype(np.float32)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            self.boxes[lo, hi] = self.t[lo:hi].min(0), self.t[lo:hi].max(0)
        return self.boxes[lo, hi]


def _apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def join_parts(a: Part, b: Part | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each vector of a to b, and of b to a; copies count), and a forest of the links. b None: a with itself."""
    other = a if b is None else b
    reach = 2 - 2 * least + SLACK
    links = [np.zeros(len(a.ids), np.int64), np.zeros(len(other.ids), np.int64)]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(a.ids), 0, len(other.ids))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if b is None and j1 <= i0:
            continue
        if _apart(a.box(i0, i1), other.box(j0, j1)) > reach:
            continue
        if i1 - i0 > LEAF or j1 - j0 > LEAF:
            si = [(i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)] if i1 - i0 > LEAF else [(i0, i1)]
            sj = [(j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)] if j1 - j0 > LEAF else [(j0, j1)]
            stack += [(*x, *y) for x in si for y in sj]
            continue
        # The distance over some directions is the whole one at most.
        half = a.left[i0:i1] @ other.right[j0:j1].T
        if b is None and i0 == j0:
            np.fill_diagonal(half, -np.inf)
        if half.max() < -reach / 2 - ROUNDING:
            continue
        x, y = np.nonzero(half >= -reach / 2 - ROUNDING)
        if len(x) * 16 < half.size:
            good = np.einsum("ij,ij->i", a.v[i0 + x], other.v[j0 + y]) >= least
        else:
            good = (a.v[i0:i1] @ other.v[j0:j1].T >= least)[x, y]
        if b is None:
            good &= i0 + x < j0 + y
        x, y = x[good], y[good]
        if not len(x):
            continue
        np.add.at(links[0], i0 + x, other.copies[j0 + y])
        np.add.at(links[1], j0 + y, a.copies[i0 + x])
        u, m = forest(np.minimum(a.ids[i0 + x], other.ids[j0 + y]), np.maximum(a.ids[i0 + x], other.ids[j0 + y]))
        edges.append((u, m))
    u, m = forest(*(np.concatenate(x) for x in zip(*edges, strict=True))) if edges else (np.empty(0, np.int64),) * 2
    return links[0], links[1], u, m


def _joined(rotations: dict[int, np.ndarray], least: float, kind: str) -> Callable:
    """Rows of two intervals to (vec_id, n, linked): links of a vector, linked null, and a forest of the links, n 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Part] = {}

        def part(batch: pa.RecordBatch, i: int, side: str, dim: int) -> Part:
            place = batch.column(f"{side}_place")[i].as_py()
            if place not in parts:
                if len(parts) > TOGETHER:
                    parts.pop(next(iter(parts)))
                read = lambda name, kind: np.frombuffer(batch.column(f"{side}_{name}")[i].as_buffer(), kind)
                parts[place] = Part(read("ids", np.int64), read("copies", np.int64), read("vectors", kind).astype(float).reshape(-1, dim), rotations[dim])
            return parts[place]

        for batch in batches:
            ids, counts, edges = [], [], []
            for i in range(len(batch)):
                dim = batch.column("a_dim")[i].as_py()
                a, b = part(batch, i, "a", dim), part(batch, i, "b", dim)
                one, two, u, m = join_parts(a, None if a is b else b, least)
                ids += [a.ids[one > 0], b.ids[two > 0]]
                counts += [one[one > 0], two[two > 0]]
                edges.append((u, m))
            if not edges:
                continue
            vec, at = np.unique(np.concatenate(ids), return_inverse=True)
            n = np.zeros(len(vec), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            u, m = forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
            linked = pa.array(np.concatenate([vec, m]), mask=np.arange(len(vec) + len(m)) < len(vec))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([vec, u])), pa.array(np.concatenate([n, np.zeros(len(u), np.int64)])), linked], ["vec_id", "n", "linked"])

    return released(run)


PACKED = "place long, dim int, ids binary, copies binary, vectors binary, low array<double>, high array<double>"


def _pack(rotations: dict[int, np.ndarray], kind: str, most: int) -> Callable:
    """A range partition, sorted in grid order, as one row for at most `most` vectors, with the box around them."""

    def row(rows: list[tuple], seq: int) -> pa.RecordBatch:
        dim = rows[0][1]
        given = np.frombuffer(b"".join(r[5] for r in rows), kind).reshape(len(rows), dim)
        t = scaled(given.astype(float)) @ rotations[dim]
        # The factor is odd: the sum of two places is as often even as odd, by partitions and inside one.
        packed = [[rows[0][0] * ((1 << 20) + 1) + seq], [dim], [np.array([r[3] for r in rows], np.int64).tobytes()], [np.array([r[4] for r in rows], np.int64).tobytes()], [given.tobytes()], [t.min(0).tolist()], [t.max(0).tolist()]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(packed, kinds, strict=True)], ["place", "dim", "ids", "copies", "vectors", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seq = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("part", "dim", "key", "vec_id", "copies", "vector")), strict=True):
                if held and held[-1][1:3] == r[1:3]:
                    continue  # the same row again
                if held and (len(held) == most or held[0][1] != r[1]):
                    yield row(held, seq)
                    held, seq = [], seq + 1
                held.append(r)
        if held:
            yield row(held, seq)

    return released(run)


def _meeting(intervals: DataFrame, reach: float) -> DataFrame:
    """Every two intervals, and each with itself, whose boxes are within reach, once. A product without a key: Spark reads the files
    of one side again for those of the other and shuffles neither."""
    a, b = (intervals.select(*[F.col(c).alias(f"{k}_{c}") for c in intervals.columns]) for k in "ab")
    # Which of the two is a goes by the parity of their places, so that tasks have as many pairs each.
    even = (F.col("a_place") + F.col("b_place")) % 2 == 0
    once = (F.col("a_place") == F.col("b_place")) | (even == (F.col("a_place") < F.col("b_place")))
    gap = F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    return a.join(b, (F.col("a_dim") - F.col("b_dim") == 0) & once & (apart <= reach)).select("a_dim", *[f"{k}_{c}" for k in "ab" for c in ("place", "ids", "copies", "vectors")])


# ---------------------------------------------------------------- the operator


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision is at least `least`. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable, kept says whether that is the vector itself.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths with each other. A row with a null id links with nothing and is kept. Rows that repeat an id count
    as separate vectors where their vectors differ and share the id's component; repeats of an id and
    its vector count as copies of each other. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    epsilon = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector_"))
    whole = rows.where("vec_id is not null and vector_ is not null")
    sums = whole.mapInArrow(_moments, "dim int, sums binary").repartition(8, "dim").mapInArrow(_added, "dim int, sums binary").collect()  # a matrix for each vector length
    total: dict[int, np.ndarray] = {}
    for d, raw in sums:
        total[d] = total.get(d, 0) + np.frombuffer(raw)
    rotations = {d: principal(x, d) for d, x in total.items()}

    given = vectors.schema[vector_column].dataType
    kind = "<f4" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "<f8"
    placed = whole.mapInArrow(_cells(rotations, epsilon, kind), "vec_id long, dim int, cell binary, key binary, vector binary")
    # Equal vectors are one: the smallest id stands for them.
    ids = placed.select("vec_id", "key")
    same = ids.groupBy("key").agg(F.min("vec_id").alias("least_"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    members = ids.join(same, "key", "left").select("vec_id", "key", F.coalesce("least_", "vec_id").alias("least_"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = cut(members, "grid-members")
    twins = members.where("copies > 1").select("vec_id", "key", F.when(F.col("vec_id") == F.col("least_"), F.col("copies")).otherwise(0).alias("copies")).distinct()
    alone = placed.join(cut(twins, "grid-twins"), ["vec_id", "key"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")

    # Range partitions are the files of intervals: of one interval each while they are few, of up to TOGETHER later.
    n = -(-4 * int(sum(x[0] for x in total.values())) // (3 * INTERVAL))
    files = max(1, min(n, 2 * spark.sparkContext.defaultParallelism), -(-n // TOGETHER))
    ordered = alone.repartitionByRange(files, "dim", "cell", "key").sortWithinPartitions("dim", "cell", "key", "vec_id").withColumn("part", F.spark_partition_id())
    ordered = ordered.select("part", "dim", "key", "vec_id", F.col("copies").cast("long").alias("copies"), "vector")
    intervals = cut(ordered.mapInArrow(_pack(rotations, kind, INTERVAL), PACKED), "grid-intervals")
    found = cut(_meeting(intervals, 2 - 2 * least + SLACK).mapInArrow(_joined(rotations, least, kind), "vec_id long, n long, linked long"), "grid-links")

    links = found.where("linked is null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    edges = found.where("linked is not null").select(F.col("vec_id").alias("a"), F.col("linked").alias("b")).union(members.where("vec_id <> least_").select("vec_id", "least_"))
    components = connected_components(edges, "grid-components")
    counted = members.join(links.withColumnRenamed("vec_id", "least_"), "least_", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Rows with equal ids and different vectors would multiply: of those the largest count stands for the id.
    counted = counted.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(counted, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
