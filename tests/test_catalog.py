"""Catalog queries against their SQL, on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog
from gridloom.streaming.cells import running_cells

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: One of each kind; the others are held against their SQL by the driver.
SAMPLE = ["grid_cells", "grid_extent", "cell_blocks", "boundary_cells", "best_cut", "splitline_l2", "district_stats", "order_violations", "stats_diff", "bridges", "hilbert_cut", "rescale", "coverage_median", "apportion", "rle", "scanline", "condorcet", "worklist"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_parses_and_has_a_query(db):
    for name, sql in entry.oracle_sql().items():
        assert name in entry.queries()
        db.execute("explain " + sql)


def test_kernels_cover_their_grids(spark):
    for name in ("accretion_west", "accretion_centre", "repair_splitline"):
        got = catalog.QUERIES[name](spark, SF).toPandas()
        assert len(got) == len(catalog.QUERIES["grid_cells"](spark, SF).toPandas())
        assert not got.duplicated(["state", "r", "c"]).any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_of_blocks(spark, tmp_path):
    src = spark.createDataFrame([("S", 0, 0, 5), ("S", 0, 0, 7), ("S", 1, 0, 1)], "state string, r int, c int, pop int")
    src.write.parquet(str(tmp_path / "in"))
    q = running_cells(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("cells_now").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("cells_now").collect()) == [("S", 0, 0, 12, 2), ("S", 1, 0, 1, 1)]
