"""Writers of artifacts whose bytes are fixed: lines in a total order, line feeds only.

An artifact is one state's map, so it is gathered on the driver one state at a time."""

from __future__ import annotations

import colorsys
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GOLDEN_ANGLE, LIGHTNESS, PALETTE, SATURATION


def write_assignment(assigned: DataFrame, state, path: str) -> str:
    """row,col,district,pop of one state, by row and column; gives the SHA-256 of the bytes."""
    rows = assigned.where(F.col("state") == state).select("r", "c", "district", "pop").orderBy("r", "c").toLocalIterator()
    digest = hashlib.sha256()
    with Path(path).open("wb") as f:
        for line in ["row,col,district,pop\n", *(f"{r[0]},{r[1]},{r[2]},{r[3]}\n" for r in rows)]:
            f.write(line.encode())
            digest.update(line.encode())
    return digest.hexdigest()


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores of one state's arms, in the order of arms; numbers to four places of their exact values."""
    head = "arm,eligible,gateFailures,maxAbsDevPct,meanAbsDevPct,irregularCount,meanPpn,repairMoves,sha256\n"
    with Path(path).open("w", newline="\n") as f:
        f.write(head)
        for r in scores.orderBy("arm").toLocalIterator():
            f.write(f"{r['arm']},{str(r['eligible']).lower()},{r['gate_failures']},{r['max_abs_dev_pct']:.4f},{r['mean_abs_dev_pct']:.4f},{r['irregular_count']},{r['mean_ppn']:.4f},{r['repair_moves']},{r['sha256']}\n")


def feature_collection(districts: Iterable[dict]) -> str:
    """GeoJSON of districts given as dicts with rings (outer ring first, then its holes, lists of [x, y]) and six properties."""
    keys = ("district", "pop", "deviationPct", "cells", "ppn", "irregular")
    features = []
    for d in districts:
        shapes = [[ring + ring[:1] for ring in shape] for shape in d["shapes"]]
        kind = {"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes}
        features.append({"type": "Feature", "properties": {k: d[k] for k in keys}, "geometry": kind})
    return json.dumps({"type": "FeatureCollection", "features": features}, separators=(",", ":"))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG of 8-bit colours."""
    if len(rgb) != width * height * 3:
        raise ValueError("rgb does not fit the size")

    lines = b"".join(b"\0" + rgb[k * width * 3 : (k + 1) * width * 3] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 9)) + _chunk(b"IEND", b"")


def colour(district: int) -> tuple[int, int, int]:
    """The palette of twelve, then hues a golden angle apart; the same as functions.scalars.district_rgb."""
    if district <= len(PALETTE):
        return tuple(bytes.fromhex(PALETTE[max(district, 1) - 1]))
    r, g, b = colorsys.hls_to_rgb((district - 1) * GOLDEN_ANGLE % 360 / 360, LIGHTNESS, SATURATION)
    return tuple(int(x * 255 + 0.5) for x in (r, g, b))


def write_stats(stats: DataFrame, state, arm: str, repair: dict[str, int], sha256: str, path: str) -> None:
    """One arm's statistics: how it was repaired, the hash of its assignment, and a row a district."""
    rows = stats.where(F.col("state") == state).orderBy("district").toLocalIterator()
    districts = [{"district": r["district"], "pop": r["pop"], "cells": r["cells"], "deviationPct": r["deviation_pct"], "ppn": r["ppn"], "aspect": r["aspect"], "fill": r["fill"], "irregular": r["irregular"]} for r in rows]
    Path(path).write_text(json.dumps({"arm": arm, "sha256": sha256, "repair": repair, "districts": districts}, indent=1) + "\n")


def write_sealed(sealed: DataFrame, state, path: str) -> None:
    """The pockets that an arm met, in order; an empty list where it met none."""
    rows = [{"district": r["district"], "pop": r["pop"], "reason": r["reason"]} for r in sealed.where(F.col("state") == state).orderBy("n").toLocalIterator()]
    Path(path).write_text(json.dumps(rows, indent=1) + "\n")


def geojson(stats: DataFrame, shapes: DataFrame, state) -> str:
    """One state's districts as GeoJSON, their shapes from raster.shapes."""
    both = stats.join(shapes, ["state", "district"]).where(F.col("state") == state).orderBy("district")
    districts = [{"district": r["district"], "pop": r["pop"], "deviationPct": r["deviation_pct"], "cells": r["cells"], "ppn": r["ppn"], "irregular": r["irregular"], "shapes": r["shapes"]} for r in both.toLocalIterator()]
    return feature_collection(districts)


def write_geojson(stats: DataFrame, shapes: DataFrame, state, path: str) -> None:
    Path(path).write_text(geojson(stats, shapes, state) + "\n")


#: Rows of cells that a task codes as one strip of a PNG.
STRIP_ROWS = 64
#: Adler-32 is of sums modulo this.
_ADLER = 65521


def png_strips(cells: DataFrame, pixel: int = 1) -> DataFrame:
    """(strip, body, adler, size, width, height): coded strips of the picture of cells (r, c, v), each cell pixel x pixel in the colour of v, white
    elsewhere. A strip ends with a full flush, so that strips put behind each other are one stream; adler is of its own bytes."""
    box = cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    strips = F.explode(F.sequence(F.lit(0), F.floor((F.col("r1") - F.col("r0")) / STRIP_ROWS).cast("int"))).alias("strip")
    frame = box.where("r0 IS NOT NULL").select(strips, (F.col("r1") - F.col("r0") + 1).alias("rows"), (F.col("c1") - F.col("c0") + 1).alias("cols"))
    placed = cells.crossJoin(F.broadcast(box)).select((F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v")  # one row

    def code(key: tuple, own: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        strip, rows, cols = int(key[0]), int(whole["rows"].iloc[0]), int(whole["cols"].iloc[0])
        n = min(STRIP_ROWS, rows - strip * STRIP_ROWS)
        rgb = np.full((n, cols, 3), 255, np.uint8)
        if len(own):
            colours = {v: colour(int(v)) for v in own["v"].unique()}
            rgb[own["r"].to_numpy() - strip * STRIP_ROWS, own["c"].to_numpy()] = np.array([colours[v] for v in own["v"]], np.uint8)
        lines = np.repeat(np.repeat(rgb, pixel, 0), pixel, 1).reshape(n * pixel, -1)
        raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], 1).tobytes()
        last = (strip + 1) * STRIP_ROWS >= rows
        pack = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = pack.compress(raw) + pack.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
        return pd.DataFrame([(strip, body, zlib.adler32(raw), len(raw), cols * pixel, rows * pixel)], columns=["strip", "body", "adler", "size", "width", "height"])

    own = placed.withColumn("strip", F.floor(F.col("r") / STRIP_ROWS).cast("int"))
    return own.groupBy("strip").cogroup(frame.groupBy("strip")).applyInPandas(code, "strip int, body binary, adler long, size long, width int, height int")


def joined_adler(first: int, second: int, size: int) -> int:
    """Adler-32 of two texts behind each other from theirs and the second's size."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (b1 + b2 + size * (a1 - 1)) % _ADLER << 16 | (a1 + a2 - 1) % _ADLER


def png_of(cells: DataFrame, pixel: int = 1) -> bytes:
    """A PNG of one map; only its coded strips come here."""
    adler, body, size = 1, [], (0, 0)
    for s in png_strips(cells, pixel).orderBy("strip").toLocalIterator():
        adler, size = joined_adler(adler, s["adler"], s["size"]), (s["width"], s["height"])
        body.append(bytes(s["body"]))
    stream = b"\x78\xda" + b"".join(body) + struct.pack(">I", adler)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", stream) + _chunk(b"IEND", b"")


def svg(cells: Iterable[tuple[int, int, int]], stats: Iterable[dict], size: int = 6) -> str:
    """One square a cell (row, column, district) and a line of legend a district; irregular ones have a star."""
    cells = list(cells)
    h, w = max((r for r, _, _ in cells), default=0) + 1, max((c for _, c, _ in cells), default=0) + 1
    stats = list(stats)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w * size + 160} {max(h * size, 16 * len(stats) + 16)}">', '<rect width="100%" height="100%" fill="#fff"/>']
    out += [f'<rect x="{c * size}" y="{r * size}" width="{size}" height="{size}" fill="rgb{colour(d)}"/>' for r, c, d in cells]
    out += [f'<text x="{w * size + 8}" y="{16 * (i + 1)}" font-size="12">D{s["district"]}{"*" if s["irregular"] else ""} {s["pop"]:,} ({s["deviationPct"]:+.3f}%)</text>' for i, s in enumerate(stats)]
    return "\n".join([*out, "</svg>"]) + "\n"


def leaflet(title: str, geojson: str) -> str:
    """A page that shows a GeoJSON text on a map; the text is part of the page."""
    safe = geojson.replace("<", "\\u003c")
    return f"""<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css">
<script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script></head>
<body><div id="map" style="height:100vh"></div><script>
const data = {safe};
const map = L.map("map");
const layer = L.geoJSON(data, {{style: f => ({{weight: 1, fillOpacity: 0.5, color: `hsl(${{f.properties.district * 137.5}},60%,45%)`}}), onEachFeature: (f, l) => l.bindPopup(Object.entries(f.properties).map(x => x.join(": ")).join("<br>"))}}).addTo(map);
map.fitBounds(layer.getBounds());
</script></body></html>
"""
