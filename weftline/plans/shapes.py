"""Readers and writers that need a folder of their own shape, each on files made from the nation table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import union_all
from weftline.plans.registry import query
from weftline.sources import config, readers, writers
from weftline.storage import step_folder, table

_SHAPES = ["relations", "slice", "escaped", "inferred", "projected", "results", "runs", "splits", "fallback", "weights"]


@query(
    "q127_reader_shapes",
    f"""
    with n as (select n_nationkey as key, n_name as name, n_regionkey as region from nation),
    s as (select unnest({_SHAPES}) as shape)
    select shape, key, case shape when 'runs' then 'run ' || (key % 7) when 'splits' then (case when region < 2 then 'head' else 'tail' end) || ':' || name when 'escaped' then 'é' || name when 'relations' then 'region_' || region || ':' || name else name end as value
    from s, n where (shape <> 'slice' or key between 5 and 14) and (shape <> 'results' or (region in (1, 3))) and (shape <> 'runs' or region = 2) and (shape <> 'weights' or key % 5 = 0)""",
)
def reader_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Nested relation files by directory, a slice of lines, escaped and inferred CSV, projected parquet, result files chosen by name, run folders with siblings, splits, a chain of sources and dictionary rows with bad norms."""
    base, nation = step_folder(spark, "shapes"), table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    regions = [0, 1, 2, 3, 4]  # fixed by the table
    sample = F.struct(F.col("name").alias("subject"), F.col("key").cast("string").alias("object"))
    for r in regions:
        one = nation.where(F.col("region") == r)
        body = F.to_json(F.struct(F.lit(f"region_{r}").alias("name"), F.array(F.lit("{} lies in")).alias("prompt_templates"), F.array_sort(F.collect_list(sample)).alias("samples")))
        one.agg(body.alias("value")).coalesce(1).write.text(f"{base}/relations/region_{r}")
        one.agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "name")))).alias("value")).coalesce(1).write.text(f"{base}/results/{'keep' if r % 2 else 'skip'}_{r}")
        if r == 2:
            for row in one.select("key").collect():  # five run folders
                for file in ("grade", "stats"):
                    config.put(spark, json.dumps({"key": row["key"]}), f"{base}/runs/m_mi{row['key']}__run{row['key'] % 7}/{file}.json")
    writers.json_lines(nation, base + "/lines")
    nation.select("key", F.concat(F.lit("\\xe9"), "name").alias("name")).write.csv(base + "/escaped", header=True, quote="'", escape="'")
    nation.select("key", "name").write.csv(base + "/plain", header=True)
    nation.write.parquet(base + "/table")
    for part, kept in (("head", "region < 2"), ("tail", "region >= 2")):
        nation.where(kept).select("key", "name").write.parquet(f"{base}/splits/{part}")
    nation.select("key", "name", F.array(F.when(F.col("key") % 5 == 0, 2.0).otherwise(1.0), F.lit(0.0)).alias("dec")).write.parquet(base + "/dictionary")

    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    relations = spark.read.schema("name string, samples array<struct<subject:string,object:string>>").json(f"{base}/relations/*").select(folder.alias("relation"), F.explode("samples").alias("s"))
    results = readers.result_folder(spark, f"{base}/results/*", "key int, name string", include=["part"]).select("key", "name", folder.alias("dir")).where(F.startswith("dir", F.lit("keep")))
    frames = {
        "relations": relations.select(F.col("s.object").alias("key"), F.concat("relation", F.lit(":"), "s.subject").alias("value")),
        "slice": readers.json_lines_slice(spark, base + "/lines", "key int, name string", order="key", start=5, limit=10).withColumnRenamed("name", "value"),
        "escaped": readers.csv_unicode_escape(spark, base + "/escaped", ["key", "name"]).withColumnRenamed("name", "value"),
        "inferred": readers.csv_inferred(spark, base + "/plain").withColumnRenamed("name", "value"),
        "projected": readers.projected(spark, base + "/table", ["key", "name"]).withColumnRenamed("name", "value"),
        "results": results.select("key", F.col("name").alias("value")),
        "runs": readers.discover_runs(spark, base + "/runs", "grade.json", "stats.json", r"_mi\d+").select(F.col("mi").alias("key"), F.concat(F.lit("run "), "run").alias("value")),
        "splits": readers.splits(spark, base + "/splits", ["head", "tail"]).select("key", F.concat("split", F.lit(":"), "name").alias("value")),
        "fallback": readers.first_that_loads(lambda: spark.read.parquet(base + "/none"), lambda: spark.read.parquet(base + "/table")).select("key", F.col("name").alias("value")),
        "weights": readers.weights(spark, base + "/dictionary", {"dec": "w_dec"})[1].select("key", F.col("name").alias("value")),
    }
    return union_all(*[f.select(F.lit(s).alias("shape"), F.col("key").cast("int").alias("key"), F.col("value").cast("string").alias("value")) for s, f in frames.items()])


@query(
    "q128_writer_shapes",
    """
    with n as (select n_nationkey as key, n_name as name from nation)
    select 'document' as shape, key, name as value from n
    union all select 'appended', key, name from n where key < 10 union all select 'appended', key, name from n where key >= 10
    union all select 'refused', key, name from n where key < 10
    union all select 'kept', key, name from n where key / 24.0 > 0.8
    union all select 'flattened', key, 'good:' || name from n where key < 4
    union all select 'config', 3, 'nation' union all select 'problems', 2, 'missing: b|unknown: z' union all select 'named', 12, 'nation_train_'""",
)
def writer_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that replace each other, lines appended or refused, rows kept by a score, a tree of runs as one table, configs and names made from them."""
    base, nation = step_folder(spark, "written"), table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    fields = "key int, name string"
    for part in (nation.limit(3), nation):  # the second replaces the first
        writers.document(part, base + "/document")
    for condition in ("key < 10", "key >= 10"):
        writers.json_lines(nation.where(condition), base + "/appended", append=True)
    for condition in ("key < 10", "key >= 10"):
        try:
            writers.json_lines(nation.where(condition), base + "/refused", refuse=True)
        except Exception as e:  # there are rows already
            if "exists" not in str(e).lower():
                raise
    writers.kept_rows(nation.withColumn("f1", F.col("key") / 24.0), F.col("f1") > 0.8, base + "/kept")
    for row in nation.where("key < 4").collect():  # four run folders
        folder = f"{base}/tree/m_mi{row['key']}__run1"
        config.put(spark, json.dumps({"score": row["key"], "grade": "good"}), folder + "/hypothesis_grade.json")
        config.put(spark, f" {row['name']} \n", folder + "/description.txt")
    flat = writers.flatten_runs(spark, base + "/tree", base + "/runs.jsonl")
    made = {"dataset_name": "nation", "batch_size": 4, "n": 3}
    config.save(spark, made, base + "/config.yaml")
    loaded = config.load(spark, base + "/config.yaml")
    problems, name = config.problems({"a": 1, "z": 2}, {"a", "b"}, {"a", "b"}), writers.config_name(made, "train")
    few = [("config", len(loaded), loaded["dataset_name"]), ("problems", len(problems), "|".join(problems)), ("named", len(name) - len("nation_train_"), name[: len("nation_train_")])]
    frames = [spark.read.schema(fields).json(f"{base}/{s}").select(F.lit(s).alias("shape"), "key", F.col("name").alias("value")) for s in ("document", "appended", "refused", "kept")]
    frames.append(flat.select(F.lit("flattened").alias("shape"), F.col("mi").alias("key"), F.concat("grade", F.lit(":"), "description").alias("value")))
    return union_all(*frames, spark.createDataFrame(few, "shape string, key int, value string"))
