"""Writers: cached datasets under content-derived names, appended logs and exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def config_name(config: dict, split: str) -> str:
    """A name from the canonical JSON of a config, its batch size aside, and the split."""
    kept = {k: v for k, v in config.items() if k != "batch_size"} | {"split": split}
    canonical = json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str)
    base = str(config.get("dataset_name", "dataset")).translate(str.maketrans("/. ", "___"))
    return f"{base}_{split}_{hashlib.blake2s(canonical.encode(), digest_size=6).hexdigest()}"


def cached_dataset(spark: SparkSession, folder: str, config: dict, split: str, create: Callable[[], DataFrame]) -> DataFrame:
    """The dataset of a config, made and saved on the first call, read on later ones."""
    path = f"{folder}/{config_name(config, split)}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        create().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".config")
    return spark.read.parquet(path)


def document(df: DataFrame, path: str) -> None:
    """One record a line, in place of what was there."""
    df.write.mode("overwrite").json(path)


def json_lines(df: DataFrame, path: str, *, append: bool = False, refuse: bool = False) -> None:
    """JSON lines; ``append`` adds to what is there, ``refuse`` is an error if there is any."""
    df.write.mode("append" if append else "errorifexists" if refuse else "overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def eval_log(df: DataFrame, path: str, step: int) -> None:
    """Results of one step added to a log that is partitioned by step; what is there isn't read."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)


def kept_rows(df: DataFrame, condition: Column, path: str) -> None:
    """Rows that pass, e.g. a score above a limit."""
    df.where(condition).write.mode("overwrite").json(path)


def migrate(spark: SparkSession, source: str, target: str, schema: str, renames: dict[str, str]) -> DataFrame:
    """Result files with old keys written to a new folder under new keys; where both are given, the new one holds."""
    rows = spark.read.schema(schema).json(source)
    new = [F.coalesce(F.col(n), F.col(o)).alias(n) if n in rows.columns else F.col(o).alias(n) for o, n in renames.items()]
    others = [c for c in rows.columns if c not in renames and c not in renames.values()]
    rows.select(*others, *new).write.mode("overwrite").json(target)
    return spark.read.json(target)


def flatten_runs(spark: SparkSession, folder: str, target: str, pattern: str = r"_mi\d+") -> DataFrame:
    """A tree of run folders (grade and description each) as one table of records: run, mi, run_idx, score, grade, description."""
    from weftline.sources.readers import discover_runs

    found = discover_runs(spark, folder, "hypothesis_grade.json", "description.txt", pattern)
    at = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    grades = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "hypothesis_grade.json").schema("score int, grade string").option("multiLine", True).json(folder).select("*", at)
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "description.txt").text(folder, wholetext=True).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("description"), at)
    key = lambda df: df.withColumn("folder", F.regexp_replace("folder", "^file:/+", "/"))
    runs = key(found).join(key(grades), "folder").join(key(texts), "folder")
    rows = runs.select(F.substring_index("folder", "/", -1).alias("name"), "mi", F.col("run").alias("run_idx"), "score", "grade", "description")
    rows.write.mode("overwrite").json(target)
    return rows
