"""Intermediate tables that outlive their lineage.

Everything that cuts a lineage goes through :func:`materialise`: it writes Parquet below the folder that the
session names in ``spark.checkpoint.dir`` (shared by driver and executors), so the loss of an executor never
loses the rows.  Only local sessions may leave that setting empty; they get a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quarry-")
        _roots[app] = f"{base.rstrip('/')}/quarry-{app}"
        atexit.register(_forget, spark, app)
    return _roots[app]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with whatever file system it lives on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, app: str) -> None:
    try:
        remove(spark, _roots.pop(app))
    except Exception:  # the session may be gone already: nothing is left to tidy with
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once and returns the written table."""
    return spark_table(df)[0]


def spark_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Like :func:`materialise`, with the path, for loops that drop what they no longer need."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
