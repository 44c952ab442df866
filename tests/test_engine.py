"""Whole runs, sources and writers, gates that raise, and published maps."""

import io
import json
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import graph, metrics, raster, repair, vintages
from gridloom.plans import engine
from gridloom.sources import download, readers, writers

CELL = "state string, r int, c int, pop long"


def grid_of(spark, *names):
    return spark.createDataFrame([(s, r, c, 5 + (r * 7 + c * 3 + len(s)) % 11) for s in names for r in range(8) for c in range(9)], CELL)


@pytest.fixture(scope="module")
def done(spark):
    seats = spark.createDataFrame([("A", 3), ("BB", 2)], "state string, seats int")
    return engine.run(grid_of(spark, "A", "BB"), seats, 3)


def test_a_run_has_every_arm_of_every_state(done):
    scored = done.scored.toPandas()
    assert sorted(zip(scored["state"], scored["arm"], strict=True)) == sorted((s, a) for s in ("A", "BB") for a in engine.ARMS)
    assert scored["g2_contiguity"].all() and scored["g4_coverage"].all()
    assert sorted(scored[scored["state"] == "A"]["arm_rank"]) == [1, 2, 3, 4]
    assert {r.status for r in done.ledger.collect()} == {"done"}


def test_artifacts_of_a_state(spark, done, tmp_path):
    extents = spark.createDataFrame([("A", 1609.344 * 3, 1609.344 * 900)], "state string, origin_x double, origin_y_top double")
    paths = engine.write_artifacts(done, "A", extents, tmp_path / "A")
    assert {p.name for p in paths} >= {"assign_hilbert.csv", "stats_splitline.json", "districts_accretion-west.geojson", "sealed_accretion-west.json", "scores.csv"}
    assert readers.read_assignment(spark, str(tmp_path / "A/assign_hilbert.csv")).count() == 72
    scores = {r.arm: r for r in readers.read_scores(spark, str(tmp_path / "A/scores.csv")).collect()}
    assert set(scores) == set(engine.ARMS)
    stats = readers.read_stats(spark, str(tmp_path / "A/stats_splitline.json")).orderBy("district").collect()
    assert [r.district for r in stats] == [1, 2, 3] and {r.sha256 for r in stats} == {scores["splitline"].sha256}
    geo = json.loads((tmp_path / "A/districts_splitline.geojson").read_text())
    assert len(geo["features"]) == 3
    for f in geo["features"]:
        assert set(f["properties"]) == {"district", "pop", "deviationPct", "cells", "ppn", "irregular"}
        ring = f["geometry"]["coordinates"][0]
        assert ring[0] == ring[-1] and all(-97 < x < -94 and 20 < y < 40 and round(x, 6) == x for x, y in ring)


def test_a_hole_goes_to_the_ring_around_it(spark):
    frame = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    own = spark.createDataFrame([("S", r, c, 1) for r, c in [*frame, (9, 9), (9, 10)]], "state string, r int, c int, district int")
    extents = spark.createDataFrame([("S", 0.0, 0.0)], "state string, origin_x double, origin_y_top double")
    shapes = raster.shapes(raster.dissolve(own), extents).first().shapes
    assert sorted(len(x) for x in shapes) == [1, 2]


def test_a_state_that_fails_is_a_row(spark):
    a = grid_of(spark, "A", "B").withColumn("district", F.when(F.col("state") == "A", 1 + F.col("c") % 2).otherwise(9))
    seats = spark.createDataFrame([("A", 2), ("B", 2)], "state string, seats int")
    got = repair.repair_all(a, seats, errors=True)
    assert [(r.state, r.district) for r in got.where("error is not null").collect()] == [("B", None)]
    assert got.where("error is null").count() == 72
    with pytest.raises(Exception, match="districts outside"):
        repair.repair_all(a, seats).collect()


def test_results_do_not_depend_on_order(spark, done):
    seats = spark.createDataFrame([("BB", 2), ("A", 3)], "state string, seats int")
    mixed = grid_of(spark, "BB", "A").repartition(7, "c").sortWithinPartitions(F.desc("r"))
    key = ["state", "arm", "r", "c", "district"]
    assert sorted(engine.run(mixed, seats, 3).assigned.select(*key).collect()) == sorted(done.assigned.select(*key).collect())


def test_verdicts_of_a_run(spark, done):
    resident = done.assigned.where("arm = 'hilbert'").groupBy("state").agg(F.sum("pop").alias("resident_pop"))
    got = {(r.state, r.arm): (r.ok, r.verdict) for r in engine.verify_run(done, resident, ("hilbert", "splitline"), gate_pct=0.0, flag_only=["A"]).collect()}
    assert len(got) == 4 and all(ok for ok, _ in got.values())
    assert {v for (s, _), (_, v) in got.items() if s == "A"} <= {"flag", "pass"}


def test_scores_say_each_gate(spark):
    stats = spark.createDataFrame([(s, "x", d, dev, False, 0.8) for s, devs in (("CO", [1.5, -1.5]), ("NY", [4.0, -4.0]), ("TX", [4.0])) for d, dev in enumerate(devs, 1)], "state string, arm string, district int, deviation_pct double, irregular boolean, ppn double")
    seats = spark.createDataFrame([("CO", 2), ("NY", 2), ("TX", 3)], "state string, seats int")
    whole = spark.createDataFrame([("CO", "x", True), ("NY", "x", True)], "state string, arm string, contiguous boolean")
    moves = spark.createDataFrame([("CO", "x", 7)], "state string, arm string, repair_moves long")
    got = {r.state: (r.eligible, r.gate_failures, r.repair_moves) for r in metrics.scores(stats, seats, whole, moves).collect()}
    assert got == {"CO": (False, "G1-population", 7), "NY": (True, "G1-flagged-not-failed", 0), "TX": (False, "G1-population+G2-contiguity+G4-coverage", 0)}


# ---------------------------------------------------------------- gates


def test_a_preview_gives_nothing_when_a_gate_fails(spark):
    estimates = spark.createDataFrame([("A", 100, 120), ("B", 300, 290)], "state string, base long, est long")
    official = spark.createDataFrame([("A", 100, 1), ("B", 300, 3)], "state string, pop long, seats int")
    constants = spark.createDataFrame([("A", 1, 100), ("B", 3, 300)], "state string, seats int, resident_pop long")
    got = {r.state: (r.seats, r.delta) for r in engine.seat_preview(estimates, official, constants, 4).collect()}
    assert got == {"A": (1, 0), "B": (3, 0)}
    with pytest.raises(Exception, match="gate failed: base drift"):
        engine.seat_preview(estimates.withColumn("base", F.col("base") + 9), official, constants, 4).collect()
    with pytest.raises(Exception, match="gate failed: official seats again"):
        engine.seat_preview(estimates, official.withColumn("seats", F.lit(2)), constants.withColumn("seats", F.lit(2)), 4).collect()
    with pytest.raises(Exception, match="gate failed: inputs"):
        engine.seat_preview(estimates.limit(1), official, constants, 4).collect()


def test_unknown_states_raise(spark):
    dim = spark.createDataFrame([("A", 5), ("B", None)], "state string, resident_pop long")
    ask = lambda s: vintages.require_states(spark.createDataFrame([(s,)], "state string"), dim).collect()
    assert ask("A")[0].resident_pop == 5
    with pytest.raises(Exception, match="unknown state Z"):
        ask("Z")
    with pytest.raises(Exception, match="no verified population of B"):
        ask("B")


# ---------------------------------------------------------------- sources


def test_fetch_waits_longer_after_each_failure(tmp_path):
    waits, left = [], [OSError("no"), OSError("no"), b"body"]

    def opened(url):
        x = left.pop(0)
        if isinstance(x, OSError):
            raise x
        return io.BytesIO(x)

    assert download.fetch("u", tmp_path / "d" / "f", wait=waits.append, opened=opened).read_bytes() == b"body"
    assert waits == [5.0, 10.0]
    with pytest.raises(OSError, match="never"):
        download.fetch("u", tmp_path / "g", tries=1, opened=lambda url: (_ for _ in ()).throw(OSError("never")))
    assert not list(tmp_path.glob("g*"))


def test_archives_are_fetched_once(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("in/tab.DBF", b"dbf")
        z.writestr("in/tab.shp", b"shp")
    asked = []

    def opened(url):
        asked.append(url)
        return io.BytesIO(raw.getvalue())

    for _ in range(2):
        paths = download.cached("http://h/tab.zip", tmp_path, (".dbf", ".shp"), opened=opened)
    assert [p.read_bytes() for p in paths] == [b"dbf", b"shp"] and asked == ["http://h/tab.zip"]


def write_shape(folder: Path, codes: list[str], rings: list[list[list[tuple[float, float]]]]) -> str:
    body = b""
    for i, own in enumerate(rings, 1):
        points = [p for ring in own for p in ring]
        starts = [sum(map(len, own[:k])) for k in range(len(own))]
        record = struct.pack("<I4d2I", 5, 0, 0, 9, 9, len(own), len(points)) + struct.pack(f"<{len(own)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">II", i, len(record) // 2) + record
    (folder / "b.shp").write_bytes(struct.pack(">I", 9994) + b"\0" * 96 + body)
    index, at = b"", 0
    while at < len(body):
        words = struct.unpack(">II", body[at : at + 8])[1]
        index += struct.pack(">II", (100 + at) // 2, words)
        at += 8 + 2 * words
    (folder / "b.shx").write_bytes(struct.pack(">I20xI72x", 9994, (100 + len(index)) // 2) + index)
    fields = b"STATEFP".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([2, 0]) + b"\0" * 14
    (folder / "b.dbf").write_bytes(struct.pack("<B3BIHH", 3, 1, 1, 1, len(codes), 65, 3).ljust(32, b"\0") + fields + b"\r" + b"".join(b" " + c.encode() for c in codes) + b"\x1a")
    return str(folder / "b.shp")


def test_the_first_polygon_of_a_state(spark, tmp_path):
    square = lambda x: [(x, 0.0), (x, 2.0), (x + 2.0, 2.0), (x, 0.0)]
    path = write_shape(tmp_path, ["01", "08", "08"], [[square(0.0)], [square(5.0), square(6.0)], [square(9.0)]])
    got = readers.read_boundary(spark, path, "08").orderBy("ring_id", "seq").collect()
    assert [(r.ring_id, r.x, r.y) for r in got] == [(i, x, y) for i, s in enumerate((5.0, 6.0)) for x, y in square(s)]
    with pytest.raises(ValueError, match="no polygon"):
        readers.read_boundary(spark, path, "99")


def test_quoted_text_over_lines_and_in_latin(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'code , name\r\n01,"two\r\nlines, ""said"""\r\n02,"Do\xf1a Ana"\r\n')
    got = readers.read_quoted(spark, str(tmp_path / "a.csv"), ["code", "name"], "ISO-8859-1", multi_line=True).collect()
    assert [r.code for r in got] == ["01", "02"]
    assert got[0].name.replace("\r\n", "\n") == 'two\nlines, "said"' and got[1].name == "Doña Ana"


def test_dense_grids_and_simple_lines(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"rows": 2, "cols": 3, "inState": [0, 1, 1, 1, 0, 1], "pop": [0, 4, 0, 7, 0, 9]}))
    assert sorted(tuple(r) for r in readers.read_grid_json(spark, str(tmp_path / "g.json")).collect()) == [(0, 1, 4), (0, 2, 0), (1, 0, 7), (1, 2, 9)]
    lines = spark.createDataFrame([("S", 0, [0.0, 1.0, 2.0, 3.0], [0.0, 0.01, 0.0, 5.0])], "state string, ring_id int, xs array<double>, ys array<double>")
    assert raster.simplified(lines, 0.1).first().xs == [0.0, 2.0, 3.0]


def test_colours_agree(spark):
    got = spark.range(1, 80).select("id", scalars.district_rgb(F.col("id")).alias("x")).collect()
    assert all(max(abs(a - b) for a, b in zip(r.x, writers.colour(r.id), strict=True)) <= 1 for r in got)
