"""Column functions whose results must not depend on engine or row order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Albers equal-area projection of the conterminous states on GRS80, and the cell of one mile.
CELL_M = 1609.344
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257222101
LAT_0, LON_0, LAT_1, LAT_2 = 23.0, -96.0, 29.5, 45.5


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, for negatives too."""
    return F.floor(x + F.lit(0.5))


def round_to(x: Column, digits: int) -> Column:
    return half_up(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def cell_index(r: Column, c: Column, cols: Column | int) -> Column:
    return r * cols + c


def cell_row_col(i: Column, cols: Column | int) -> tuple[Column, Column]:
    """The inverse of cell_index."""
    return F.floor(i / cols).cast("int"), (i % cols).cast("int")


# The twelve colours of the first districts.
PALETTE = ("4e79a7", "f28e2b", "e15759", "59a14f", "b07aa1", "edc948", "76b7b2", "ff5d8f", "9c755f", "17becf", "bcbd22", "8c564b")
GOLDEN_ANGLE, SATURATION, LIGHTNESS = 137.508, 0.62, 0.52


def district_rgb(district: Column) -> Column:
    """A struct of red, green and blue: a palette of twelve, then hues a golden angle apart."""
    fixed = F.array(*[F.struct(*[F.lit(int(x[i : i + 2], 16)).alias(k) for i, k in ((0, "red"), (2, "green"), (4, "blue"))]) for x in PALETTE])
    hue = (district - 1) * F.lit(GOLDEN_ANGLE) % 360 / 30
    chroma = SATURATION * min(LIGHTNESS, 1 - LIGHTNESS)

    def channel(shift: int) -> Column:
        # The channel's trapezium over the colour circle of twelve parts.
        k = (hue + shift) % 12
        return half_up((F.lit(LIGHTNESS) - F.lit(chroma) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255).cast("int")

    return F.when(district <= len(PALETTE), F.element_at(fixed, F.least(F.greatest(district, F.lit(1)), F.lit(len(PALETTE))).cast("int"))).otherwise(F.struct(channel(0).alias("red"), channel(8).alias("green"), channel(4).alias("blue")))


def family_keys(r: Column, c: Column) -> Column:
    """The four cut families as (family, key): columns, rows, both diagonals."""
    return F.array(*[F.struct(F.lit(f).alias("fam"), k.cast("int").alias("k")) for f, k in ((0, c), (1, r), (2, r + c), (3, r - c))])


def ppn(cells: Column, exposed: Column) -> Column:
    """Polsby-Popper over that of a square; unbounded (null here) without exposed edges."""
    return F.when(exposed > 0, (F.lit(4 * math.pi) * cells / (exposed * exposed)) / F.lit(math.pi / 4))


def irregular(ppn_: Column, aspect: Column, fill: Column) -> Column:
    return (ppn_ < 0.45) | (aspect > 2) | (fill < 0.45)


def deviation_pct(pop: Column, ideal: Column) -> Column:
    return (pop - ideal) / ideal * 100


def hilbert_index(x: Column, y: Column, side: int | Column) -> Column:
    """Place of (x, y) on the Hilbert curve over a side x side square, side a power of two: a number, or a column of at most 2^30.

    The bits are folded from the highest down. A fold over the levels keeps the expression small; written out, each level
    would repeat the one above it twice."""
    halves = [1 << k for k in range(29, -1, -1)] if isinstance(side, Column) else [1 << k for k in range(side.bit_length() - 2, -1, -1)]
    if not halves:
        return F.lit(0).cast("long")
    levels = F.array(*[F.lit(s).cast("long") for s in halves])
    if isinstance(side, Column):
        levels = F.filter(levels, lambda s: s < side)

    def step(acc: Column, s: Column) -> Column:
        ax, ay = acc["x"], acc["y"]
        rx, ry = ax.bitwiseAND(s) > 0, ay.bitwiseAND(s) > 0
        quarter = F.when(rx, F.when(ry, 2).otherwise(3)).otherwise(F.when(ry, 1).otherwise(0))
        # Only bits below s are read from here on; flipped against s - 1 they may go negative above.
        fx = F.when(ry, ax).when(rx, s - 1 - ay).otherwise(ay)
        fy = F.when(ry, ay).when(rx, s - 1 - ax).otherwise(ax)
        return F.struct(fx.alias("x"), fy.alias("y"), (acc["d"] + s * s * quarter).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(levels, start, step, lambda acc: acc["d"])


def _albers_constants() -> tuple[float, float, float, float, float]:
    f = 1 / INVERSE_FLATTENING
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    def q(p: float) -> float:
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))

    p0, p1, p2 = (math.radians(v) for v in (LAT_0, LAT_1, LAT_2))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return e2, e, n, c, SEMI_MAJOR * math.sqrt(c - n * q(p0)) / n


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north (forward projection)."""
    e2, e, n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = F.lit(1 - e2) * (s / (1 - F.lit(e2) * s * s) - F.lit(1 / (2 * e)) * F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)))
    rho = F.lit(SEMI_MAJOR / n) * F.sqrt(F.lit(c) - F.lit(n) * q)
    theta = F.lit(n) * F.radians(lon - F.lit(LON_0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def to_lonlat(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """The inverse, by the series of a fixed number of steps for the latitude, folded so that the expression stays small."""
    e2, e, n, c, rho0 = _albers_constants()
    dy = F.lit(rho0) - y
    rho2 = x * x + dy * dy
    start = (F.lit(c) - rho2 * F.lit((n / SEMI_MAJOR) ** 2)) / F.lit(n)

    def step(acc: Column, _: Column) -> Column:
        phi, q = acc["phi"], acc["q"]
        s = F.sin(phi)
        one = 1 - F.lit(e2) * s * s
        more = one * one / (2 * F.cos(phi)) * (q / F.lit(1 - e2) - s / one + F.lit(1 / (2 * e)) * F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)))
        return F.struct((phi + more).alias("phi"), q.alias("q"))

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.asin(start / 2).alias("phi"), start.alias("q")), step, lambda acc: acc["phi"])
    return F.lit(LON_0) + F.degrees(F.atan2(x, dy)) / F.lit(n), F.degrees(phi)
