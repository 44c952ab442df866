"""Readers of the contract files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ASSIGN_CSV, SCORES_CSV
from .binary import enable


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """An assignment CSV: the header must be row,col,district,pop and every field a whole number, else reading fails."""
    return spark.read.schema(ASSIGN_CSV).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_scores(spark: SparkSession, path: str, arm: str | None = None) -> DataFrame:
    df = spark.read.schema(SCORES_CSV).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df if arm is None else df.where(F.col("arm") == arm)


def read_quoted(spark: SparkSession, path: str, required: list[str], encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """A CSV with quotes, kept as text: leading zeros stay. Header names lose a byte-order mark and outer white space; the
    required ones must be there."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df


def read_grid_json(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, pop) of the in-state cells of a dense grid (rows, cols, inState, pop)."""
    g = spark.read.schema("rows INT, cols INT, inState ARRAY<INT>, pop ARRAY<INT>").option("multiLine", True).json(path)
    cells = g.select("cols", F.posexplode(F.arrays_zip("inState", "pop")).alias("i", "x")).where("x.inState = 1")
    return cells.select(F.floor(F.col("i") / F.col("cols")).cast("int").alias("r"), (F.col("i") % F.col("cols")).alias("c"), F.col("x.pop").cast("long").alias("pop"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row of a state's facts: state, seats, ideal, resident population, extent."""
    return spark.read.schema("state STRING, seats INT, idealTarget DOUBLE, residentPop BIGINT, rows INT, cols INT, originX DOUBLE, originYTop DOUBLE").option("multiLine", True).json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A row a district of an arm's statistics file."""
    kind = "arm STRING, sha256 STRING, repair STRUCT<orphanCellsMoved: INT, rebalanceMoves: INT>, districts ARRAY<STRUCT<district: INT, pop: BIGINT, cells: INT, deviationPct: DOUBLE, ppn: DOUBLE, irregular: BOOLEAN>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select("arm", "sha256", (F.col("repair.orphanCellsMoved") + F.col("repair.rebalanceMoves")).alias("repair_moves"), F.explode("districts").alias("d")).select("arm", "sha256", "repair_moves", "d.*")


def read_display_grid(spark: SparkSession, path: str) -> DataFrame:
    """(state, seats, ideal, r, c, district) of a published map: run lengths as pairs of value and length, row by row, 0 outside."""
    g = spark.read.schema("abbr STRING, seats INT, ideal DOUBLE, h INT, w INT, rle ARRAY<INT>").option("multiLine", True).json(path)
    runs = g.select("abbr", "seats", "ideal", "w", "rle", F.posexplode(F.expr("filter(rle, (x, i) -> i % 2 = 1)")).alias("k", "n"))
    start = F.aggregate(F.slice(F.expr("filter(rle, (x, i) -> i % 2 = 1)"), F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    cells = runs.select("abbr", "seats", "ideal", "w", F.element_at("rle", (2 * F.col("k") + 1).cast("int")).alias("district"), start.alias("at"), "n").where("district <> 0")
    i = cells.select("abbr", "seats", "ideal", "w", "district", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("i"))
    return i.select(F.col("abbr").alias("state"), "seats", "ideal", F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), "district")


def read_boundary(spark: SparkSession, path: str, *statefp: str) -> DataFrame:
    """(state, ring_id, seq, x, y): the corners of the polygons of a .shp file with these STATEFP, of each its first record. Records of other states
    are left out by the scan."""
    own = enable(spark).read.format("shp").load(path).where(F.col("STATEFP").isin(*statefp))
    own = own.select(F.col("STATEFP").alias("state"), F.monotonically_increasing_id().alias("k"), "rings")
    first = own.groupBy("state").agg(F.min_by("rings", "k").alias("rings"))
    found = {r[0] for r in first.select("state").collect()}
    if missing := sorted(set(statefp) - found):
        raise ValueError(f"no polygon of state {', '.join(missing)} in {path}")
    rings = first.select("state", F.posexplode("rings").alias("ring_id", "ring"))
    return rings.select("state", "ring_id", F.posexplode("ring").alias("seq", "p")).select("state", "ring_id", "seq", "p.x", "p.y")


def read_blocks(spark: SparkSession, path: str, state: str) -> DataFrame:
    """Block rows (state, geoid, pop, lon, lat) of a DBF of census blocks: only four fields are read."""
    raw = enable(spark).read.format("dbf").option("columns", "GEOID20,POP20,INTPTLON20,INTPTLAT20").load(path)
    number = lambda c: F.trim(c).cast("double")
    return raw.select(F.lit(state).alias("state"), F.col("GEOID20").alias("geoid"), F.trim("POP20").cast("int").alias("pop"), number("INTPTLON20").alias("lon"), number("INTPTLAT20").alias("lat"))
