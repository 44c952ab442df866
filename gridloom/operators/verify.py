"""Checks of finished assignments. They import no engine module."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def population(assigned: DataFrame, districts: DataFrame, resident: DataFrame) -> DataFrame:
    """One row a state: the three totals, whether they agree, the largest deviation and its district."""
    csv = assigned.groupBy("state").agg(F.sum("pop").cast("long").alias("csv_pop"))
    d = districts.groupBy("state").agg(F.sum("pop").cast("long").alias("district_pop"), F.max(F.abs("deviation_pct")).alias("max_abs_dev_pct"), F.max(F.struct(F.abs("deviation_pct"), -F.col("district"))).alias("w"))
    out = csv.join(d, "state", "full_outer").join(resident, "state", "full_outer")
    ok = (F.col("csv_pop") == F.col("district_pop")) & (F.col("csv_pop") == F.col("resident_pop"))
    return out.select("state", "csv_pop", "district_pop", "resident_pop", "max_abs_dev_pct", (-F.col("w.col2")).cast("int").alias("worst_district"), F.coalesce(ok, F.lit(False)).alias("ok"))


def verdicts(checked: DataFrame, gate_pct: float = 2.0, flag_only: list[str] | None = None) -> DataFrame:
    """population()'s rows with verdict: fail where totals differ; beyond the gate, flag in the states of flag_only and fail elsewhere."""
    over = F.coalesce(F.col("max_abs_dev_pct") > F.lit(gate_pct), F.lit(True))
    flagged = F.col("state").cast("string").isin(flag_only or [])
    return checked.withColumn("verdict", F.when(~F.col("ok"), "fail").when(over & flagged, "flag").when(over, "fail").otherwise("pass"))


def missing_cells(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    return expected.select("state", "r", "c").join(assigned.select("state", "r", "c"), ["state", "r", "c"], "left_anti")


def extra_cells(expected: DataFrame, assigned: DataFrame) -> DataFrame:
    return assigned.select("state", "r", "c").join(expected.select("state", "r", "c"), ["state", "r", "c"], "left_anti")


def duplicate_cells(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("state", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty_districts(assigned: DataFrame, seats: DataFrame) -> DataFrame:
    """(state, district) of 1..seats without a cell."""
    want = seats.select("state", F.explode(F.sequence(F.lit(1), F.col("seats"))).alias("district"))
    return want.join(assigned.select("state", "district").distinct(), ["state", "district"], "left_anti")


def order_violations(lines: DataFrame) -> DataFrame:
    """Rows of a file (state, line, r, c) that do not come behind the row before them."""
    w = Window.partitionBy("state").orderBy("line")
    before = F.lag(F.struct("r", "c")).over(w)
    return lines.withColumn("before", before).where(F.col("before").isNotNull() & (F.struct("r", "c") <= F.col("before"))).select("state", "line", "r", "c")


def stats_diff(derived: DataFrame, reported: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(state, district, column, derived, reported) where the two sources differ, absent rows included."""
    d = derived.select("state", "district", *[F.col(c).cast("double").alias(f"d_{c}") for c in columns])
    r = reported.select("state", "district", *[F.col(c).cast("double").alias(f"r_{c}") for c in columns])
    both = d.join(r, ["state", "district"], "full_outer")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("derived"), F.col(f"r_{c}").alias("reported")) for c in columns])).alias("x")
    return both.select("state", "district", pairs).select("state", "district", "x.*").where(~F.coalesce(F.abs(F.col("derived") - F.col("reported")) <= tolerance, F.lit(False)))


def unknown_geoids(cell_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids listed under cells that the block table does not hold."""
    return cell_blocks.select("state", F.explode("geoids").alias("geoid")).join(blocks.select("state", "geoid"), ["state", "geoid"], "left_anti")


def unbacked_cells(assigned: DataFrame, cell_blocks: DataFrame) -> DataFrame:
    """Populated cells of an assignment without any block."""
    return assigned.where("pop > 0").join(cell_blocks.select("state", "r", "c"), ["state", "r", "c"], "left_anti").select("state", "r", "c", "pop")


def fingerprint(assigned: DataFrame) -> DataFrame:
    """(state, sha256) of each state's lines `row,col,district,pop` in order, each with its line feed, under the header.

    The lines of a state are one text by nature (the artifact itself); states are hashed apart."""
    line = F.concat_ws(",", "r", "c", "district", "pop")
    rows = assigned.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("r", "c", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("row,col,district,pop\n"), F.array_join(F.col("rows.line"), "\n"), F.lit("\n"))
    return rows.select("state", F.sha2(text, 256).alias("sha256"))


def fingerprint_stream(assigned: DataFrame, header: str = "row,col,district,pop") -> DataFrame:
    """fingerprint() in constant memory: a state's lines stream through one hash in order, and only the hash is kept. States are
    dealt over tasks and sorted there; a hash is sequential, so a state is one stream of one task, however long."""
    kind = dict(assigned.dtypes)["state"]
    lines = assigned.select("state", "r", "c", F.concat_ws(",", "r", "c", "district", "pop").alias("line"))
    sorted_ = lines.repartition("state").sortWithinPartitions("state", "r", "c", "line").select("state", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, digest = None, None
        for b in batches:
            names = b.column("state")
            # The first row of each run of a state in the batch.
            turns = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows] if b.num_rows else [0, 0]
            for lo, hi in zip(turns, turns[1:], strict=False):
                if hi == lo:
                    continue
                own = names[lo].as_py()
                if digest is None or own != state:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([state], names.type), pa.array([digest.hexdigest()])], names=["state", "sha256"])
                    state, digest = own, hashlib.sha256(f"{header}\n".encode())
                digest.update(("\n".join(b.column("line")[lo:hi].to_pylist()) + "\n").encode())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], names.type), pa.array([digest.hexdigest()])], names=["state", "sha256"])

    return sorted_.mapInArrow(run, f"state {kind}, sha256 string")


def against_frozen(hashes: DataFrame, frozen: DataFrame) -> DataFrame:
    """(key, input_sha256, sha256, verdict): each run's hash against the frozen one of the same key and input: same, differs, or new where
    none is frozen. hashes and frozen: (key, input_sha256, sha256)."""
    known = frozen.select("key", "input_sha256", F.col("sha256").alias("was"))
    both = hashes.join(known, ["key", "input_sha256"], "left")
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("sha256"), "same").otherwise("differs")
    return both.select("key", "input_sha256", "sha256", verdict.alias("verdict"))


def changed_arms(hashes: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows (state, arm, sha256) of hashes whose latest entry in the ledger (state, arm, sha256, at) is another hash, or that have none: what has
    to be verified again."""
    last = ledger.groupBy("state", "arm").agg(F.max_by("sha256", "at").alias("sha256"))
    return hashes.join(last, ["state", "arm", "sha256"], "left_anti")


def first_offenders(offenders: DataFrame, n: int = 5) -> DataFrame:
    """(state, total, sample): how many rows there are and the first n cells, for messages."""
    w = Window.partitionBy("state").orderBy("r", "c")
    numbered = offenders.withColumn("k", F.row_number().over(w))
    cell = F.when(F.col("k") <= n, F.struct("k", F.concat_ws(",", "r", "c").alias("cell")))
    out = numbered.groupBy("state").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(cell)).alias("s"))
    return out.select("state", "total", F.array_join(F.col("s.cell"), " ").alias("sample"))
