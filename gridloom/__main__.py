"""python -m gridloom STAGE --blocks PATH --state S --seats N --outdir DIR: one state's stages from a table of blocks.

Stages: grid (cells and extent), run (assignments), score (statistics, scores and ranks), render (pictures), all (all of these and the files). With
--outline, cells inside the state without a block are part of the grid; with --resident, people must add up to it before a cell is written."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import attach
from .plans import engine
from .sources.readers import read_blocks, read_boundary


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["grid", "run", "score", "render", "all"])
    p.add_argument("--blocks", required=True, help="Parquet of (state, geoid, pop, lon, lat), or a DBF of census blocks")
    p.add_argument("--state", required=True)
    p.add_argument("--seats", type=int, required=True)
    p.add_argument("--outline", help="a shapefile of states (.shp, with .shx and .dbf), in degrees")
    p.add_argument("--fips", help="STATEFP of the state in the outline")
    p.add_argument("--resident", type=int, help="the state's published population")
    p.add_argument("--arm", action="append", choices=[*engine.ARMS, *engine.MORE_ARMS])
    p.add_argument("--shuffle", action="store_true", help="permute the blocks first; results stay the same")
    p.add_argument("--outdir", default="out")
    a = p.parse_args(argv)
    spark = attach(SparkSession.builder.getOrCreate())
    blocks = read_blocks(spark, a.blocks, a.state) if a.blocks.endswith(".dbf") else spark.read.parquet(a.blocks).where(F.col("state") == a.state)
    if a.shuffle:
        blocks = blocks.repartition(17, F.reverse("geoid")).sortWithinPartitions(F.md5("geoid"))
    if a.outline and not a.fips:
        p.error("--outline needs --fips")
    rings = read_boundary(spark, a.outline, a.fips).withColumn("state", F.lit(a.state)) if a.outline else None
    resident = spark.createDataFrame([(a.state, a.resident)], "state string, resident_pop long") if a.resident is not None else None
    built = engine.build_grid(blocks, rings, resident)
    cells, extents = built.cells.select("state", "r", "c", "pop"), built.extents
    out = Path(a.outdir) / a.state
    if a.stage == "grid":
        cells.write.mode("overwrite").parquet(str(out / "grid"))
        extents.write.mode("overwrite").parquet(str(out / "extent"))
        return
    if a.seats == 1:
        spark.createDataFrame([(a.state, 1, True)], "state string, seats int, at_large boolean").write.mode("overwrite").json(str(out / "meta"))
        return  # one district: no grid is cut
    seats = spark.createDataFrame([(a.state, a.seats)], "state string, seats int")
    done = engine.run(cells, seats, a.seats, tuple(a.arm or engine.ARMS))
    if a.stage == "run":
        done.assigned.write.mode("overwrite").partitionBy("arm").parquet(str(out / "assigned"))
    elif a.stage == "score":
        done.scored.write.mode("overwrite").parquet(str(out / "scores"))
    elif a.stage == "render":
        engine.write_maps(done, a.state, extents, out)
    else:
        engine.write_artifacts(done, a.state, extents, out)
        engine.write_maps(done, a.state, extents, out)
    done.ledger.write.mode("overwrite").json(str(out / "ledger"))


if __name__ == "__main__":
    main()
