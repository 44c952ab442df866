"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set and Spark runs on this machine alone (as in tests), a folder of it, removed at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return root


def attach(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, which may not have it installed. Once a context; before
    operators that run Python are built."""
    context = spark.sparkContext
    if not any(x.startswith("gridloom-") for x in context._python_includes):
        home = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / f"gridloom-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, str(Path(home.name) / f.relative_to(home)))
        context.addPyFile(str(path))
        atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    return spark


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back: its lineage ends there, and
    what it holds no longer depends on any executor. instead_of: the round before, itself from cut and not needed any more; its
    files are deleted once df is written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    old = _paths.get(id(instead_of)) if instead_of is not None else None
    if old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


#: Where the tables of this session that come from cut were written.
_paths: dict[int, str] = {}
