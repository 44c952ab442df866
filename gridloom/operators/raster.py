"""Rasters of grids: run lengths, downsampling, scan lines, outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CELL_M, round_to, to_lonlat

Point = tuple[int, int]


def rle_encode(cells: DataFrame) -> DataFrame:
    """(state, run, v, len) over each state's box of cells, row by row, 0 where there is no cell. cells: (state, r, c, v).

    Cells make runs inside their rows, gaps between runs are filled with runs of 0, and runs that go on over row ends are merged. No cell of
    the box is made that is not there; rows of a state are worked on apart, and what is scanned along a whole state is one summary a row."""
    box = cells.groupBy("state").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("c") - F.min("c") + 1).cast("long").alias("w"))
    line = Window.partitionBy("state", "r").orderBy("c")
    fresh = F.when((F.col("c") - F.lag("c").over(line) == 1) & (F.col("v") == F.lag("v").over(line)), 0).otherwise(1)
    marked = cells.where("v <> 0").select("state", "r", "c", "v", fresh.alias("fresh")).withColumn("k", F.sum("fresh").over(line))
    runs = marked.groupBy("state", "r", "k").agg(F.first("v").alias("v"), F.min("c").alias("c"), F.count(F.lit(1)).alias("len"))
    runs = runs.join(F.broadcast(box), "state").withColumn("at", (F.col("r") - F.col("r0")) * F.col("w") + F.col("c") - F.col("c0"))
    # A summary a row: its first and last run. What is before a row's first run is the last run of the nearest row above with one.
    summary = runs.groupBy("state", "r").agg(F.max(F.struct("at", "len", "v")).alias("last"))
    above = summary.select("state", "r", F.lag("last").over(Window.partitionBy("state").orderBy("r")).alias("above"))
    by_row = Window.partitionBy("state", "r").orderBy("at")
    held = runs.join(above, ["state", "r"]).withColumn("before", F.coalesce(F.lag(F.struct("at", "len", "v")).over(by_row), F.col("above")))
    ends = F.coalesce(F.col("before.at") + F.col("before.len"), F.lit(0))
    held = held.withColumn("gap", F.col("at") - ends).withColumn("joins", (F.col("at") == ends) & F.coalesce(F.col("before.v") == F.col("v"), F.lit(False)))
    # Pieces: a gap of 0 before a run where there is one, and the run; a run that joins the one before it starts nothing.
    parts = F.array_compact(F.array(F.when(F.col("gap") > 0, F.struct((F.col("at") - F.col("gap")).alias("at"), F.lit(0).alias("v"), F.col("gap").alias("len"), F.lit(1).alias("starts"))), F.struct("at", "v", "len", F.when(F.col("joins"), 0).otherwise(1).alias("starts"))))
    pieces = held.select("state", "r", F.explode(parts).alias("p")).select("state", "r", "p.*")
    tail = cells.groupBy("state").agg(F.max("r").alias("r1")).join(box, "state").join(summary.groupBy("state").agg(F.max(F.struct("r", "last")).alias("m")), "state", "left")
    size = (F.col("r1") - F.col("r0") + 1) * F.col("w")
    end = F.coalesce(F.col("m.last.at") + F.col("m.last.len"), F.lit(0))
    rest = tail.where(size > end).select("state", F.col("r1").alias("r"), end.alias("at"), F.lit(0).alias("v"), (size - end).alias("len"), F.lit(1).alias("starts"))
    pieces = pieces.unionByName(rest)
    # Numbers of runs: starts within a row, behind the starts of the rows above.
    starts = pieces.groupBy("state", "r").agg(F.sum("starts").alias("n"))
    higher = starts.select("state", "r", F.coalesce(F.sum("n").over(Window.partitionBy("state").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("higher"))
    numbered = pieces.join(higher, ["state", "r"]).withColumn("run", F.col("higher") + F.sum("starts").over(by_row))
    return numbered.groupBy("state", "run").agg(F.first("v").alias("v"), F.sum("len").alias("len"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(state, i, v) of the cells that are not 0, i the place in the box."""
    w = Window.partitionBy("state").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0))).where("v <> 0")
    return at.select("state", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("i"), "v")


def majority(cells: DataFrame, step: int) -> DataFrame:
    """(state, br, bc, v): the most frequent value of each step x step bucket, ties to the least value."""
    n = cells.groupBy("state", F.floor(F.col("r") / step).alias("br"), F.floor(F.col("c") / step).alias("bc"), "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("state", "br", "bc").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).select("state", "br", "bc", "m.v")


def scanline(segments: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """(poly, y, x_from, x_to): spans inside polygons on whole rows y (even-odd). segments: (poly, x1, y1, x2, y2).

    A segment meets only the rows that it spans; crossings of a row are paired in order."""
    y = F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.ceil(F.greatest("y1", "y2")))).alias("y")
    hit = segments.where("y1 <> y2").select("*", y).withColumn("yy", F.col("y") + F.lit(epsilon)).where((F.col("y1") > F.col("yy")) != (F.col("y2") > F.col("yy")))
    x = hit.select("poly", "y", (F.col("x1") + (F.col("yy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    n = x.withColumn("k", F.row_number().over(Window.partitionBy("poly", "y").orderBy("x")) - 1)
    return n.groupBy("poly", "y", F.floor(F.col("k") / 2).alias("pair")).agg(F.min("x").alias("x_from"), F.max("x").alias("x_to")).drop("pair")


def fit_rect(points: DataFrame, width: float, height: float) -> DataFrame:
    """(poly, scale, dx, dy) that place each shape centred in width x height, the aspect kept."""
    b = points.groupBy("poly").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    s = F.least(F.lit(width) / (F.col("x1") - F.col("x0")), F.lit(height) / (F.col("y1") - F.col("y0")))
    return b.withColumn("scale", s).select("poly", "scale", ((F.lit(width) - F.col("scale") * (F.col("x1") + F.col("x0"))) / 2).alias("dx"), ((F.lit(height) - F.col("scale") * (F.col("y1") + F.col("y0"))) / 2).alias("dy"))


def largest_rings(areas: DataFrame, most: int) -> DataFrame:
    """(state, ring_id, area): of each state the rings of largest area."""
    w = Window.partitionBy("state").orderBy(F.abs("area").desc(), "ring_id")
    return areas.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def outline_edges(cells: DataFrame) -> DataFrame:
    """(state, district, r, c, side): sides of cells that no cell of the district is behind; side 0 north, 1 east, 2 south, 3 west."""
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for s, (dr, dc) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1)))])).alias("d")
    ask = cells.select("state", "district", "r", "c", steps).select("state", "district", "r", "c", "d.side", (F.col("r") + F.col("d.dr")).alias("nr"), (F.col("c") + F.col("d.dc")).alias("nc"))
    there = cells.select("state", "district", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return ask.join(there, ["state", "district", "nr", "nc"], "left_anti").select("state", "district", "r", "c", "side")


def stitch(cells: set[Point]) -> list[list[Point]]:
    """Rings of corners (row, column) around cells, the cells to the right of each way; corners in a line are left out.

    At a corner where two cells touch only there, the ring turns right and so keeps to its own cell."""
    ways: dict[Point, list[Point]] = {}
    for r, c in cells:
        for a, b, n in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if n not in cells:
                ways.setdefault(a, []).append(b)
    rings = []
    for start in sorted(ways):
        while ways[start]:
            ring, at, came = [start], start, None
            while True:
                out = ways[at]
                if len(out) > 1 and came is not None:
                    # Clockwise travel: right of (dr, dc) is (dc, -dr).
                    right = (at[0] + came[1], at[1] - came[0])
                    nxt = right if right in out else min(out)
                else:
                    nxt = min(out)
                out.remove(nxt)
                came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
                if at == start:
                    break
                ring.append(at)
            n = len(ring)
            rings.append([p for i, p in enumerate(ring) if (ring[i][0] - ring[i - 1][0], ring[i][1] - ring[i - 1][1]) != (ring[(i + 1) % n][0] - ring[i][0], ring[(i + 1) % n][1] - ring[i][1])])
    return rings


def ring_sum(ring: list[Point]) -> float:
    """Signed area with columns as x and rows as y downwards: positive for outer rings made by stitch."""
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def dissolve(assigned: DataFrame) -> DataFrame:
    """(state, district, ring, hole, rows, cols): the rings around each district, one group a district."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = stitch(set(zip(pdf["r"].tolist(), pdf["c"].tolist(), strict=True)))
        return pd.DataFrame({"state": pdf["state"].iloc[0], "district": pdf["district"].iloc[0], "ring": range(len(rings)), "hole": [ring_sum(x) < 0 for x in rings], "rows": [[p[0] for p in x] for x in rings], "cols": [[p[1] for p in x] for x in rings]})

    kinds = dict(assigned.dtypes)
    return assigned.select("state", "district", "r", "c").groupBy("state", "district").applyInPandas(run, f"state {kinds['state']}, district int, ring int, hole boolean, rows array<int>, cols array<int>")


def shapes(rings: DataFrame, extents: DataFrame, cell: float = CELL_M, digits: int = 6) -> DataFrame:
    """(state, district, shapes): each district as polygons, a polygon as its outer ring and its holes, a ring as [lon, lat] pairs.

    rings: as from dissolve; extents: (state, origin_x, origin_y_top). A hole belongs to the smallest outer ring whose box
    holds its box. Corners of the lattice become metres, then degrees rounded half up."""
    t = rings.join(F.broadcast(extents.select("state", "origin_x", "origin_y_top")), "state")
    t = t.select("state", "district", "ring", "hole", F.array_min("rows").alias("r0"), F.array_max("rows").alias("r1"), F.array_min("cols").alias("c0"), F.array_max("cols").alias("c1"),
                 F.transform(F.arrays_zip("rows", "cols"), lambda p: _degrees(F.col("origin_x") + p["cols"] * F.lit(cell), F.col("origin_y_top") - p["rows"] * F.lit(cell), digits)).alias("points"))
    outer = t.where("not hole").select("state", "district", F.col("ring").alias("outer"), *[F.col(c).alias(f"o_{c}") for c in ("r0", "r1", "c0", "c1")])
    # Rings of one district only meet each other: an equi-join on the district.
    held = t.where("hole").join(outer, ["state", "district"]).where("o_r0 <= r0 and r1 <= o_r1 and o_c0 <= c0 and c1 <= o_c1")
    area = (F.col("o_r1") - F.col("o_r0")) * (F.col("o_c1") - F.col("o_c0"))
    holes = held.groupBy("state", "district", "ring").agg(F.min_by("outer", F.struct(area, F.col("outer"))).alias("outer"), F.first("points").alias("points"))
    parts = t.where("not hole").select("state", "district", F.col("ring").alias("outer"), F.lit(-1).alias("ring"), "points").unionByName(holes.select("state", "district", "outer", "ring", "points"))
    whole = parts.groupBy("state", "district", "outer").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("p"))
    return whole.groupBy("state", "district").agg(F.array_sort(F.collect_list(F.struct("outer", F.col("p.points").alias("p")))).alias("s")).select("state", "district", F.col("s.p").alias("shapes"))


def _degrees(x: Column, y: Column, digits: int) -> Column:
    return F.array(*[round_to(v, digits) for v in to_lonlat(x, y)])


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """rings (state, ring_id, xs, ys) with fewer points; the first and the last stay."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [simplify(list(zip(x, y, strict=True)), tolerance) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pdf.assign(xs=[[p[0] for p in line] for line in lines], ys=[[p[1] for p in line] for line in lines])

    own = rings.select("state", "ring_id", "xs", "ys")
    return own.mapInPandas(thin, own.schema)


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The points of a line of which none that is left out is further than tolerance from it (farthest point first)."""
    if len(points) < 3:
        return list(points)
    keep = {0, len(points) - 1}
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        norm = dx * dx + dy * dy
        far, at = tolerance * tolerance, None
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / norm)) if norm else 0.0
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]
