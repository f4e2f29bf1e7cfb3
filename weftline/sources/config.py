"""Run configs as files: YAML where a YAML library is installed, else JSON, which YAML readers take too."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

try:
    import yaml
except ImportError:
    yaml = None


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, text: str, path: str) -> None:
    """Write a small file to any file system that the cluster knows; a file that is there is replaced."""
    target, files = _file(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save(spark: SparkSession, config: dict, path: str) -> None:
    put(spark, yaml.safe_dump(config, sort_keys=False) if yaml else json.dumps(config, indent=2), path)


def load(spark: SparkSession, path: str) -> dict:
    target, files = _file(spark, path)
    if not files.exists(target):
        raise FileNotFoundError(path)
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return yaml.safe_load(text) if yaml else json.loads(text)


def problems(config: dict, required: set[str], known: set[str]) -> list[str]:
    """Missing and unknown keys, as set differences."""
    return [f"missing: {k}" for k in sorted(required - set(config))] + [f"unknown: {k}" for k in sorted(set(config) - known)]
