"""A ledger of runs: entries are appended as whole folders, so that readers see all of a run's entries or none."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Entries under folder/run-000001, run-000002, ... on any file system that Spark writes to. An entry has a key, a status and whatever else the
    writer says; at is the number of its run, and the latest entry of a key counts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[int]:
        path, fs = self._path()
        if not fs.exists(path):
            return []
        found = [re.fullmatch(r"run-(\d+)", x.getPath().getName()) for x in fs.listStatus(path)]
        return sorted(int(m[1]) for m in found if m)

    def entries(self) -> DataFrame:
        """All entries, with at."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, at long")
        kept = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/run-{n:06d}" for n in runs])
        return kept.withColumn("at", F.regexp_extract(F.col("_metadata.file_path"), r"/run-(\d+)/", 1).cast("long"))

    def latest(self) -> DataFrame:
        """The latest entry of each key."""
        every = self.entries()
        last = every.groupBy("key").agg(F.max("at").alias("at"))
        return every.join(last, ["key", "at"], "left_semi")

    def append(self, rows: DataFrame) -> int:
        """Write rows aside and give them their place by a rename, which either happens or does not; gives the run's number. Where another writer
        took the number, the next one is tried."""
        aside, fs = self._path(f"_aside-{uuid.uuid4().hex}")
        rows.select(*[x.split()[0] for x in self.schema.split(",")]).write.parquet(aside.toString())
        n = (self.runs() or [0])[-1] + 1
        while True:
            place, _ = self._path(f"run-{n:06d}")
            # A rename onto a folder that is there would move into it.
            if not fs.exists(place) and fs.rename(aside, place):
                return n
            if not fs.exists(aside):
                raise OSError(f"entries are gone: {aside.toString()}")
            n += 1
            if n > 10**6:
                raise OSError(f"no place for entries in {self.folder}")
