import struct
import zlib

import pytest

from gridloom.sources import readers, writers


def _dbf(path, fields, rows):
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    body = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    path.write_bytes(head + body + b"".join(flag + b"".join(v.encode("latin-1").ljust(w) for v, (_, w) in zip(r, fields, strict=True)) for flag, *r in rows))


def test_dbf_reads_pruned_fields_and_skips_deleted(spark, tmp_path):
    fields = [("GEOID20", 15), ("POP20", 6), ("INTPTLAT20", 11), ("INTPTLON20", 12), ("OTHER", 4)]
    rows = [(b" ", f"0800{i:011d}", str(i), "+39.5000000", "-104.9000000", "x") for i in range(50)] + [(b"*", "0", "9", "0", "0", "x")]
    _dbf(tmp_path / "b.dbf", fields, rows)
    got = readers.read_blocks(spark, str(tmp_path / "b.dbf"), "CO").orderBy("geoid").collect()
    assert len(got) == 50
    assert (got[3].geoid, got[3].pop, got[3].lat, got[3].lon) == ("080000000000003", 3, 39.5, -104.9)


def test_assignment_round_trip_and_strictness(spark, tmp_path):
    a = spark.createDataFrame([("S", 1, 0, 2, 5), ("S", 0, 3, 1, 7)], "state string, r int, c int, district int, pop long")
    sha = writers.write_assignment(a, "S", str(tmp_path / "a.csv"))
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw == b"row,col,district,pop\n0,3,1,7\n1,0,2,5\n"
    import hashlib

    assert sha == hashlib.sha256(raw).hexdigest()
    assert readers.read_assignment(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("row,col,district,pop\n0,3,x,7\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        readers.read_assignment(spark, str(tmp_path / "bad.csv")).collect()


def test_quoted_csv_keeps_zeros(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes("﻿FIPS,NAME \r\n01001,\"Doña, \"\"Ana\"\"\"\r\n".encode())
    got = readers.read_quoted(spark, str(tmp_path / "q.csv"), ["FIPS", "NAME"]).collect()
    assert [tuple(r) for r in got] == [("01001", 'Doña, "Ana"')]
    with pytest.raises(ValueError):
        readers.read_quoted(spark, str(tmp_path / "q.csv"), ["POP"])


def test_png_svg_geojson():
    raw = writers.png(2, 1, bytes([255, 0, 0, 0, 0, 255]))
    at = raw.index(b"IDAT") + 4
    assert zlib.decompress(raw[at : at + struct.unpack(">I", raw[at - 8 : at - 4])[0]]) == b"\0" + bytes([255, 0, 0, 0, 0, 255])
    text = writers.svg([(0, 0, 1), (0, 1, 2)], [{"district": 2, "pop": 5, "deviationPct": 0.0, "irregular": True}])
    assert text.count("<rect") == 3
    assert "D2*" in text
    d = {"district": 1, "pop": 5, "deviationPct": 0.0, "cells": 1, "ppn": 1.0, "irregular": False, "shapes": [[[[0, 0], [1, 0], [1, 1]]]]}
    assert '"Polygon"' in writers.feature_collection([d])
    assert "</script" not in writers.leaflet("t", '{"x":"</script>"}').split("const data = ")[1].split(";\n")[0]
