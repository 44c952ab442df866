"""A virtual census over the orders table: customers become cells, orders become blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import attach


class Census:
    """state: five vertical bands of eight columns; county: customer modulo 97; a state has 3 + 2 * state seats."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = attach(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def blocks(self) -> DataFrame:
        o = self.table("orders").where("o_custkey is not null")
        k = F.col("o_custkey")
        c = (k % 40).cast("int")
        return o.select(
            F.floor((k % 40) / 8).cast("int").alias("state"),
            F.floor(k / 40).cast("int").alias("r"),
            c.alias("c"),
            F.lpad((k % 97).cast("string"), 5, "0").alias("county"),
            F.concat(F.lpad((k % 97).cast("string"), 5, "0"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("geoid"),
            F.floor(F.col("o_totalprice") / 1000).cast("long").alias("pop"),
        )

    def grid(self) -> DataFrame:
        return self.blocks().groupBy("state", "r", "c").agg(F.sum("pop").cast("long").alias("pop"))

    def island(self) -> DataFrame:
        return self.grid().where("c % 11 <> 5")

    def seats(self) -> DataFrame:
        return self.spark.range(5).select(F.col("id").cast("int").alias("state"), (3 + 2 * F.col("id")).cast("int").alias("seats"))

    def ideal(self) -> DataFrame:
        total = self.blocks().groupBy("state").agg(F.sum("pop").cast("long").alias("p"))
        return total.join(F.broadcast(self.seats()), "state").select("state", (F.col("p") / F.col("seats")).alias("ideal"))

    def resident(self) -> DataFrame:
        return self.blocks().groupBy("state").agg(F.sum("pop").cast("long").alias("resident_pop"))

    def bands(self, grid: DataFrame | None = None) -> DataFrame:
        """A plain assignment: three districts a state, by columns."""
        return (grid or self.grid()).withColumn("district", (1 + F.floor((F.col("c") % 8) / 3)).cast("int"))


#: The same in SQL, to put behind WITH.
SQL = """
block AS (SELECT CAST(floor((o_custkey % 40) / 8) AS INTEGER) AS state, CAST(floor(o_custkey / 40) AS INTEGER) AS r,
    CAST(o_custkey % 40 AS INTEGER) AS c, lpad(CAST(o_custkey % 97 AS VARCHAR), 5, '0') AS county,
    lpad(CAST(o_custkey % 97 AS VARCHAR), 5, '0') || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS geoid,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS pop FROM orders WHERE o_custkey IS NOT NULL),
grid AS (SELECT state, r, c, CAST(sum(pop) AS BIGINT) AS pop FROM block GROUP BY ALL),
island AS (SELECT * FROM grid WHERE c % 11 <> 5),
seats AS (SELECT CAST(range AS INTEGER) AS state, CAST(3 + 2 * range AS INTEGER) AS seats FROM range(5)),
resident AS (SELECT state, CAST(sum(pop) AS BIGINT) AS resident_pop FROM block GROUP BY state),
ideal AS (SELECT state, resident_pop / seats AS ideal FROM resident JOIN seats USING (state)),
bands AS (SELECT *, CAST(1 + floor((c % 8) / 3) AS INTEGER) AS district FROM grid)
"""
