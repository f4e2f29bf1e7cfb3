"""Reading tables and cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors reach. Where it is unset, a temporary one for a single local process (tests); an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


_steps: list[tuple[SparkSession, str]] = []


def step_folder(spark: SparkSession, name: str, suffix: str | None = None) -> str:
    """A path in the shared folder, a new one without ``suffix``, removed by :func:`remove_steps` or when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{suffix or uuid.uuid4().hex}"
    if not _steps:
        atexit.register(remove_steps)
    _steps.append((spark, path))
    return path


def remove_steps() -> None:
    """Remove all written steps; call it between jobs once their results are stored."""
    while _steps:
        _remove(*_steps.pop())


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages read files that every executor can reach, so a lost executor costs only its
    running tasks. The files are removed by :func:`remove_steps` or when the driver ends.
    """
    spark = df.sparkSession
    path = step_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
