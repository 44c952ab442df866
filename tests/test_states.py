"""Grids from outlines, batches and ledgers, binary sources with filters, streamed and frozen hashes, pictures, selections."""

import json
import math
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import demography, grid, kernels, orders, outline, raster, repair, verify
from gridloom.plans import batch, catalog, engine, states
from gridloom.plans.census import Census
from gridloom.plans.ledger import Ledger
from gridloom.sources import binary, readers, writers

BLOCK = "state string, geoid string, pop long, lon double, lat double"
RING = "state string, ring_id int, seq int, x double, y double"


# ---------------------------------------------------------------- outlines


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def _star(rng, lon, lat, size, n):
    return [(lon + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), lat + 0.8 * size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_cells_inside_an_outline_are_those_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    shapes = {"A": [_star(rng, -100, 40, 0.5, 12), _star(rng, -100, 40, 0.15, 5), _star(rng, -99.1, 40.2, 0.1, 7)], "B": [[(-98.0, 39.0), (-96.0, 39.0), (-96.0, 39.6), (-98.0, 39.6)]]}
    if seed % 2:
        shapes["A"] = [ring + ring[:1] for ring in shapes["A"]]  # closed, as files have them
    rings = spark.createDataFrame([(s, i, j, x, y) for s, own in shapes.items() for i, ring in enumerate(own) for j, (x, y) in enumerate(ring)], RING)
    places = [("A", f"{k:04d}", k % 9, -100 + rng.uniform(-0.4, 0.4), 40 + rng.uniform(-0.3, 0.3)) for k in range(60)] + [("B", f"{k:04d}", 1, -98.1 + 2.2 * (k % 7) / 6, 39.05 + 0.5 * (k // 7) / 6) for k in range(49)]
    # One block far out: its cell is in the state though the outline is not near.
    places.append(("A", "far", 0, -98.9, 39.4))
    built = engine.build_grid(spark.createDataFrame(places, BLOCK), rings)
    got = {(r.state, r.r, r.c): (r.pop, r.blocks) for r in built.cells.collect()}
    assert len(got) == built.cells.count()
    held = {k for k, (_, blocks) in got.items() if blocks}
    assert sum(p for p, _ in got.values()) == sum(x[2] for x in places) and sum(b for _, b in got.values()) == len(places)
    extents = {r.state: r for r in built.extents.collect()}
    every = [(s, r, c, e.origin_x + (c + 0.5) * scalars.CELL_M, e.origin_y_top - (r + 0.5) * scalars.CELL_M) for s, e in extents.items() for r in range(e.rows) for c in range(e.cols)]
    lon, lat = scalars.to_lonlat(F.col("x"), F.col("y"))
    centres = spark.createDataFrame(every, "state string, r int, c int, x double, y double").select("state", "r", "c", lon.alias("lon"), lat.alias("lat")).collect()
    want = {(p.state, p.r, p.c) for p in centres if _inside(p.lon, p.lat, shapes[p.state])} | held
    assert set(got) == want and len(want) > len(held)


def test_pieces_meet_and_are_short(spark):
    side = spark.createDataFrame([("S", -104.0, 41.0, -96.0, 41.0), ("S", -96.0, 41.0, -96.0, 41.0)], "state string, x1 double, y1 double, x2 double, y2 double")
    got = outline.pieces(side).collect()
    assert max(math.hypot(p.x2 - p.x1, p.y2 - p.y1) for p in got) < 2.1 * scalars.CELL_M
    ends = sorted(got, key=lambda p: p.x1)
    assert {(p.x1, p.y1) for p in ends[1:]} <= {(p.x2, p.y2) for p in ends}


def test_no_cell_is_given_where_people_are_lost(spark, tmp_path):
    blocks = spark.createDataFrame([("A", "1", 5, -100.0, 40.0), ("B", "2", 7, -90.0, 40.0)], BLOCK)
    right = spark.createDataFrame([("A", 5), ("B", 7)], "state string, resident_pop long")
    assert engine.build_grid(blocks, None, right).cells.count() == 2
    for wrong in (right.withColumn("resident_pop", F.col("resident_pop") + F.when(F.col("state") == "B", 1).otherwise(0)), right.where("state = 'A'")):
        with pytest.raises(Exception, match="people of the cells of B: 7, published: (8|none)"):
            engine.build_grid(blocks, None, wrong).cells.write.parquet(str(tmp_path / "cells"))
        assert not list(tmp_path.glob("cells/*.parquet"))


# ---------------------------------------------------------------- batches


def _nation(spark):
    rng = random.Random(3)
    rows = [(s, f"{s}{k}", rng.randint(1, 9), -100 + i * 2 + (k % 9) * 0.02, 40 + (k // 9) * 0.02) for i, s in enumerate(("AA", "BB", "CC")) for k in range(63)]
    blocks = spark.createDataFrame(rows, BLOCK)
    people = {s: sum(r[2] for r in rows if r[0] == s) for s in ("AA", "BB", "CC")}
    return blocks, people


def _dim(spark, people, seats):
    return spark.createDataFrame([(s, seats[s], people[s]) for s in seats], "state string, seats int, resident_pop long")


def test_a_batch_goes_on_after_failures_and_resumes(spark, tmp_path):
    blocks, people = _nation(spark)
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch.ENTRY)
    seats = {"AA": 3, "BB": 2, "CC": 1}
    first = {r.key: r for r in batch.run_batch(blocks, None, _dim(spark, people | {"BB": 1}, seats), ledger).collect()}
    assert {k: (r.status, r.stage, r.at_large, r.flagged) for k, r in first.items()} == {"AA": ("done", None, False, first["AA"].flagged), "BB": ("failed", "grid", False, True), "CC": ("done", None, True, False)}
    assert first["BB"].error == f"people of the cells: {people['BB']}, published: 1"
    a = first["AA"]
    assert a.v_cov and a.v_cont and len(a.sha256) == 64 and a.flagged == (a.gate_failures != "none" or not a.eligible) and a.v_pop == (a.max_abs_dev_pct <= 2)
    again = {r.key: r.status for r in batch.run_batch(blocks, None, _dim(spark, people, seats), ledger).collect()}
    assert again == {"BB": "done"}
    assert {(r.key, r.status, r.at) for r in ledger.latest().collect()} == {("AA", "done", 1), ("BB", "done", 2), ("CC", "done", 1)}
    assert batch.run_batch(blocks, None, _dim(spark, people, seats), ledger).count() == 0
    forced = {r.key: r.status for r in batch.run_batch(blocks, None, _dim(spark, people, seats), ledger, only=["CC"], force=True).collect()}
    assert forced == {"CC": "done"}


def test_a_state_over_its_budget_is_a_row(spark, tmp_path):
    blocks, people = _nation(spark)
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch.ENTRY)
    got = batch.run_batch(blocks, None, _dim(spark, people, {"AA": 3, "BB": 0}), ledger, arm="accretion-west", budget=-1.0).collect()
    assert {(r.key, r.status, r.stage) for r in got} == {("AA", "timeout", "assign"), ("BB", "failed", "assign")}
    assert all(r.flagged and r.eligible is None for r in got)


def test_every_kernel_gives_failures_as_rows(spark):
    cells = spark.createDataFrame([(s, r, c, -1 if (s, r, c) == ("N", 1, 1) else 5) for s in "NOK" for r in range(4) for c in range(4)], "state string, r int, c int, pop long")
    seats = spark.createDataFrame([("N", 2), ("O", None), ("K", 2)], "state string, seats int")
    arms = (*engine.ARMS, *engine.MORE_ARMS)
    done = engine.run(cells, seats, 2, arms)
    told = {r.key: (r.status, r.stage, r.error) for r in done.ledger.collect()}
    assert {k for k, v in told.items() if v[0] == "done"} == {f"K|{a}" for a in arms}
    assert {v for k, v in told.items() if k[0] == "N"} == {("failed", "assign", "ValueError: negative population of a cell")}
    assert {v for k, v in told.items() if k[0] == "O"} == {("failed", "assign", "ValueError: no seats")} and len(told) == 15
    assert {r.state for r in done.scored.collect()} == {"K"}
    with pytest.raises(Exception, match="no seats"):
        kernels.grow(orders.centre_order(cells), seats.where("state = 'O'")).collect()


def test_entries_are_there_as_a_whole_or_not(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "l"), "key string, status string")
    assert ledger.entries().count() == 0 and ledger.latest().count() == 0
    rows = spark.createDataFrame([("a", "done")], "key string, status string")
    (tmp_path / "l" / "_aside-of-a-writer-that-died").mkdir(parents=True)
    rows.write.parquet(str(tmp_path / "l" / "_aside-2"))
    assert ledger.runs() == [] and ledger.append(rows) == 1
    # Another writer took the next number meanwhile.
    rows.write.parquet(str(tmp_path / "l" / "run-000002"))
    monkeypatch.setattr(ledger, "runs", lambda: [1])
    assert ledger.append(rows.withColumn("status", F.lit("failed"))) == 3
    monkeypatch.undo()
    assert [(r.key, r.status, r.at) for r in ledger.latest().collect()] == [("a", "failed", 3)]
    assert not (tmp_path / "l" / "run-000002" / "run-000003").exists() and ledger.runs() == [1, 2, 3]


# ---------------------------------------------------------------- binary sources


def _shapefile(folder, records, fields=(("STATEFP", 2), ("NAME", 8))):
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(records), 32 + 32 * len(fields) + 1, size)
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    table, shapes, index = head, b"", b""
    for flag, values, rings in records:
        table += flag + b"".join(v.encode("latin-1").ljust(w) for v, (_, w) in zip(values, fields, strict=True))
        if rings is None:
            body = struct.pack("<I", 0)
        else:
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            points = [p for r in rings for p in r]
            body = struct.pack("<I4d2I", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">II", (100 + len(shapes)) // 2, len(body) // 2)
        shapes += struct.pack(">II", 1, len(body) // 2) + body
    for name, body in (("s.dbf", table), ("s.shp", bytes(100) + shapes), ("s.shx", struct.pack(">I20xI72x", 9994, (100 + len(index)) // 2) + index)):
        (folder / name).write_bytes(body)
    return str(folder / "s.shp")


def test_shapes_are_filtered_in_the_scan(spark, tmp_path):
    square = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)], [(x + 0.2, 0.2), (x + 0.4, 0.2), (x + 0.2, 0.4), (x + 0.2, 0.2)]]
    records = [(b" ", (f"{k:02d}", f"state {k}"), square(float(k))) for k in range(20)] + [(b" ", ("08", "again"), square(50.0)), (b"*", ("09", "gone"), square(60.0)), (b" ", ("30", "none"), None)]
    path = _shapefile(tmp_path, records)
    shapes = binary.enable(spark).read.format("shp").load(path)
    assert shapes.count() == 22 and shapes.where("NAME = 'none'").first().rings == []
    some = shapes.where("STATEFP IN ('08', '09') AND length(NAME) > 1").select("STATEFP", "NAME")
    assert sorted(map(tuple, some.collect())) == [("08", "again"), ("08", "state 8"), ("09", "state 9")]
    # A filter that the scan took is not made again behind it.
    filters = [x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter (" in x]
    assert filters and not any("STATEFP" in x for x in filters)
    got = readers.read_boundary(spark, path, "08", "03").orderBy("state", "ring_id", "seq").collect()
    assert [(r.state, r.ring_id, r.seq) for r in got] == [(s, i, j) for s in ("03", "08") for i, n in ((0, 5), (1, 4)) for j in range(n)]
    assert got[9].x == 8.0  # the first record of a state
    with pytest.raises(ValueError, match="no polygon of state 77"):
        readers.read_boundary(spark, path, "08", "77")
    table = spark.read.format("dbf").option("columns", "NAME,STATEFP").load(path[:-4] + ".dbf").where("STATEFP = '04'")
    assert [tuple(r) for r in table.collect()] == [("state 4", "04")]
    assert [tuple(r) for r in spark.read.format("dbf").load("file://" + path[:-4] + ".dbf").where("STATEFP = '05' AND NAME = 'x'").collect()] == []


def test_filtered_readers_read_no_more_than_they_must(tmp_path):
    path = _shapefile(tmp_path, [(b" ", (f"{k:02d}", "x"), [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]) for k in range(10)])
    reader = binary.ShapeReader(path, [("STATEFP", 1, 2), ("NAME", 3, 8)], 4)
    left = list(reader.pushFilters([binary.EqualTo(("STATEFP",), "07"), binary.In(("STATEFP",), ("07", "08")), binary.EqualTo(("OTHER",), "1")]))
    assert [f.attribute for f in left] == [("OTHER",)] and reader.wanted == {"STATEFP": {"07"}}
    parts = reader.partitions()
    assert [(p.start, p.end) for p in parts] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert [r[0] for p in parts for r in reader.read(p)] == ["07"]


# ---------------------------------------------------------------- hashes


def test_streamed_hashes_are_those_of_whole_texts(spark):
    rows = [(f"S{s}", r, c, 1 + (r * c) % 3, r * 7 + c) for s in range(9) for r in range(1 + 5 * s) for c in range(11)]
    a = spark.createDataFrame(rows, "state string, r int, c int, district int, pop long").repartition(7, "c")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted(map(tuple, verify.fingerprint_stream(a).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, verify.fingerprint(a).collect())) and len(got) == 9
    assert verify.fingerprint_stream(a.limit(0)).collect() == []


def test_maps_are_those_that_were_frozen(spark):
    hashes = states.splitline_hashes(Census(spark, "/root/testdata/sf0.001"))
    frozen = spark.createDataFrame(states.frozen_rows(), "key string, input_sha256 string, sha256 string")
    assert {r.verdict for r in verify.against_frozen(hashes, frozen).collect()} == {"same"}
    other = frozen.withColumn("sha256", F.lit("0"))
    assert {r.verdict for r in verify.against_frozen(hashes, other).collect()} == {"differs"}
    assert {r.verdict for r in verify.against_frozen(hashes, frozen.limit(0)).collect()} == {"new"}


def test_a_grid_that_was_never_frozen_has_no_row_as_in_the_sql(spark, tmp_path):
    """One state's people change: its grid has no frozen hash; the others are held against theirs."""
    orders_ = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders_.withColumn("o_totalprice", F.when(F.col("o_custkey") == 3, 77000.0).otherwise(F.col("o_totalprice"))).write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.QUERIES["frozen_hashes"](spark, str(tmp_path)).toPandas()
    want = db.execute(catalog.ORACLES["frozen_hashes"]).df()
    assert sorted(got["key"]) == [f"{k}|splitline" for k in range(1, 5)]
    assert sorted(got[list(want.columns)].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


# ---------------------------------------------------------------- maps of a state


def _grid(spark, name, rows, cols):
    return spark.createDataFrame([(name, r, c, 1 + (r * 5 + c) % 4) for r in range(rows) for c in range(cols)], "state string, r int, c int, pop long")


def test_a_map_does_not_depend_on_the_states_beside_it(spark):
    small, large = _grid(spark, "S", 8, 6), _grid(spark, "L", 20, 40)
    seats = spark.createDataFrame([("S", 3), ("L", 4)], "state string, seats int")
    key = ["arm", "r", "c", "district"]
    arms = ("hilbert", "centre-spiral", "accretion-west")
    alone = engine.run(small, seats.where("state = 'S'"), 4, arms).assigned.select(*key)
    beside = engine.run(small.unionByName(large), seats, 4, arms).assigned.where("state = 'S'").select(*key)
    assert sorted(alone.collect()) == sorted(beside.collect())


def test_a_spiral_goes_round_and_meets_every_cell_once(spark):
    got = {r.ord: (r.r, r.c) for r in orders.spiral_order(_grid(spark, "S", 9, 9)).collect()}
    assert sorted(got) == list(range(81)) and len(set(got.values())) == 81 and got[0] == (4, 4)
    ring = [max(abs(r - 4), abs(c - 4)) for _, (r, c) in sorted(got.items())]
    assert ring == sorted(ring)
    steps = [abs(got[k][0] - got[k + 1][0]) + abs(got[k][1] - got[k + 1][1]) for k in range(80)]
    assert sum(s > 1 for s in steps) <= 4 and [got[k] for k in range(1, 9)] == [(3, 3), (3, 4), (3, 5), (4, 5), (5, 5), (5, 4), (5, 3), (4, 3)]


def test_accretion_tells_cells_and_pockets_in_one_pass(spark):
    cells = spark.createDataFrame([("S", r, c, 4) for r in range(5) for c in range(5) if (r, c) not in {(0, 1), (1, 1), (1, 0)}], "state string, r int, c int, pop long")
    seats = spark.createDataFrame([("S", 2)], "state string, seats int")
    logged = kernels.grow_logged(orders.serpentine_order(cells, spark.createDataFrame([("S", 9)], "state string, k0 int")), seats)
    plain = kernels.accrete({(r.r, r.c): r.pop for r in cells.collect()}, sorted((r.r, r.c) for r in cells.collect()), 2)
    assert {(r.r, r.c): r.district for r in kernels.grown_of(logged).collect()} == plain[0]
    assert [(r.district, r.pop, r.reason) for r in kernels.sealed_of(logged).orderBy("n").collect()] == plain[2] != []


def test_files_of_a_state_read_back(spark, tmp_path):
    cells = _grid(spark, "A", 9, 9)
    cells = cells.where("NOT (c = 4 AND r < 8)")
    done = engine.run(cells, spark.createDataFrame([("A", 3)], "state string, seats int"), 3, ("hilbert",))
    extents = spark.createDataFrame([("A", 0.0, scalars.CELL_M * 900)], "state string, origin_x double, origin_y_top double")
    engine.write_artifacts(done, "A", extents, tmp_path)
    told = done.ledger.first()
    raw = json.loads((tmp_path / "stats_hilbert.json").read_text())["repair"]
    assert raw == {"orphanComponentsMoved": told.orphan_pieces, "orphanCellsMoved": told.orphan_cells, "rebalanceMoves": told.rebalance_moves}
    assert {r.repair_moves for r in readers.read_stats(spark, str(tmp_path / "stats_hilbert.json")).collect()} == {told.repair_moves} and told.repair_moves == told.orphan_cells + told.rebalance_moves
    maps = engine.write_maps(done, "A", extents, tmp_path / "maps", pixel=2)
    assert [p.name for p in maps] == ["map_hilbert.svg", "map_hilbert.html", "map_hilbert.png"]
    assert maps[0].read_text().count("<rect") == 1 + cells.count() and maps[0].read_text().count("<text") == 3
    assert '"FeatureCollection"' in maps[1].read_text()
    width, height, rgb = _decoded(maps[2].read_bytes())
    assert (width, height) == (18, 18)
    for r in done.assigned.collect():
        assert tuple(rgb[(2 * r.r * 18 + 2 * r.c) * 3 :][:3]) == writers.colour(r.district)


def _decoded(raw):
    """(width, height, rgb) of a PNG of one IDAT chunk without line filters, its sums checked."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    chunks, at = {}, 8
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        chunks[kind], at = body, at + 12 + n
    width, height = struct.unpack(">II", chunks[b"IHDR"][:8])
    lines = zlib.decompress(chunks[b"IDAT"])
    assert all(lines[k * (3 * width + 1)] == 0 for k in range(height))
    return width, height, b"".join(lines[k * (3 * width + 1) + 1 : (k + 1) * (3 * width + 1)] for k in range(height))


def test_strips_make_one_picture(spark, monkeypatch):
    rng = random.Random(2)
    cells = [(3 + r, 7 + c, rng.randint(1, 30)) for r in range(50) for c in range(20) if rng.random() < 0.3 or (r, c) in {(0, 0), (49, 19)}]
    cells = [x for x in cells if not 20 <= x[0] - 3 < 36]  # strips without a cell
    monkeypatch.setattr(writers, "STRIP_ROWS", 8)
    width, height, rgb = _decoded(writers.png_of(spark.createDataFrame(cells, "r int, c int, v int").repartition(5)))
    want = {(r - 3, c - 7): writers.colour(v) for r, c, v in cells}
    assert (width, height) == (20, 50)
    assert all(tuple(rgb[3 * (r * 20 + c) :][:3]) == want.get((r, c), (255, 255, 255)) for r in range(50) for c in range(20))
    # The majority raster of a map, as thumbnails have it.
    small = raster.majority(spark.createDataFrame([("S", *x) for x in cells], "state string, r int, c int, v int"), 4)
    got = _decoded(writers.png_of(small.select(F.col("br").cast("int").alias("r"), F.col("bc").cast("int").alias("c"), "v")))
    box = small.agg(F.min("br"), F.min("bc")).first()
    assert all(tuple(got[2][3 * ((r.br - box[0]) * got[0] + r.bc - box[1]) :][:3]) == writers.colour(r.v) for r in small.collect())


def test_joined_sums():
    a, b = b"abc" * 999, b"xyz" * 5000
    assert writers.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


# ---------------------------------------------------------------- selections and runs


def test_medians_are_selected(spark):
    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")
    own = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [1.0] * 40 + [2.0], "c": [5.0], "d": [-inf, inf, 0.0, 1e308, -1e308, -3.0], "e": [10.0**k for k in range(-30, 30, 3)], "f": [nan, 1.0, nan, 2.0, nan], "g": [None, None], None: [4.0, 3.0]}
    df = spark.createDataFrame([(k, v) for k, vs in own.items() for v in vs], "k string, v double").repartition(5)
    order = lambda v: (1, 0.0) if math.isnan(v) else (0, v)
    want = {k: (sorted(vs, key=order)[0], sorted(vs, key=order)[len(vs) // 2]) for k, vs in ((k, [v for v in vs if v is not None]) for k, vs in own.items()) if vs}
    for bins in (4096, 16):
        got = {r.k: (r.low, r.median) for r in demography.upper_median(df, "v", "k", bins=bins).collect()}
        assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    assert [tuple(r) for r in demography.upper_median(df.where("k = 'a'"), "v").collect()] == [want["a"]]
    assert [tuple(r) for r in demography.upper_median(df.where("k = 'g'"), "v").collect()] == [(None, None)]
    assert demography.upper_median(df.where("k = 'g'"), "v", "k").collect() == []


def test_ten_million_values_of_one_key(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % n).alias("v"))
    assert [tuple(r) for r in demography.upper_median(df, "v", "k").collect()] == [("k", 0, n // 2)]


def test_runs_are_those_of_a_dense_box(spark):
    rng = random.Random(4)
    cells = {s: {(r, c): rng.choice([0, 1, 1, 2]) for r in range(2, 9) for c in range(3, 9) if rng.random() < p and r not in gone} for s, p, gone in (("A", 0.9, ()), ("B", 0.5, (4, 5)), ("C", 1.0, ()), ("D", 0.1, ()))}
    cells["C"] = dict.fromkeys(cells["C"], 3)  # one run over all rows
    cells["E"] = dict.fromkeys([(0, 0), (0, 1)], 0)  # only what counts as nothing
    cells = {s: own for s, own in cells.items() if own}
    want = []
    for s, own in cells.items():
        r0, r1, c0, c1 = min(r for r, _ in own), max(r for r, _ in own), min(c for _, c in own), max(c for _, c in own)
        flat, runs = [own.get((r, c), 0) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)], []
        for v in flat:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        want += [(s, k, v, n) for k, (v, n) in enumerate(runs, 1)]
    df = spark.createDataFrame([(s, r, c, v) for s, own in cells.items() for (r, c), v in own.items()], "state string, r int, c int, v int")
    assert sorted(tuple(r) for r in raster.rle_encode(df).collect()) == sorted(want)


def test_published_maps_are_read(spark, tmp_path):
    rle = [0, 2, 1, 3, 2, 3, 0, 1, 1, 2, 2, 1]  # value, length: three rows of four
    (tmp_path / "g.json").write_text(json.dumps({"abbr": "ZZ", "seats": 2, "ideal": 10.5, "h": 3, "w": 4, "rle": rle}))
    got = readers.read_display_grid(spark, str(tmp_path / "g.json"))
    assert {(r.r, r.c): r.district for r in got.collect()} == {(0, 2): 1, (0, 3): 1, (1, 0): 1, (1, 1): 2, (1, 2): 2, (1, 3): 2, (2, 1): 1, (2, 2): 1, (2, 3): 2}
    assert {(r.state, r.seats, r.ideal) for r in got.collect()} == {("ZZ", 2, 10.5)}


def test_moves_are_told_apart(spark):
    a = spark.createDataFrame([("S", 0, c, 5, 1 if c in (0, 1, 7) else 2) for c in range(8)], "state string, r int, c int, pop long, district int")
    got = repair.repair_all(a, spark.createDataFrame([("S", 2)], "state string, seats int")).first()
    assert (got.orphan_pieces, got.orphan_cells) == (1, 1) and got.repair_moves == got.orphan_cells + got.rebalance_moves


def test_conservation_needs_people_of_every_state(spark):
    cells = spark.createDataFrame([("A", 0, 0, 5)], "state string, r int, c int, pop long")
    assert grid.conserved(cells, spark.createDataFrame([("A", 5), ("Z", 9)], "state string, resident_pop long")).count() == 1
