"""Where intermediate tables go: the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_STAGES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The configured shared folder. A temporary one only where none is set and all tasks run on this machine."""
    path = spark.conf.get(_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {_DIR} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="fleetspark-")
        spark.conf.set(_DIR, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGES.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise a stage as a Parquet table in the shared folder and continue from it.

    Lineage ends at files that outlive executors, so later stages neither recompute the input nor depend on it.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the stages made so far; call it when the results that read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGES:
        path = jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)
