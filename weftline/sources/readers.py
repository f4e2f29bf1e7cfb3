"""Readers for the file shapes that probe datasets come in. All are lazy; none collects rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A file that is one JSON array; no path gives an empty frame of the schema."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str = "array<array<string>>") -> DataFrame:
    """A file that is one JSON object: a row (label, value) for each member."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("label", "value"))


def relation_folder(spark: SparkSession, glob: str) -> DataFrame:
    """Nested relation files, one a relation: relation (file name), prompt_templates, subject, object."""
    schema = "name string, prompt_templates array<string>, samples array<struct<subject:string,object:string>>"
    files = spark.read.schema(schema).option("multiLine", True).json(glob).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("relation"), "prompt_templates", "samples")
    return files.select("relation", "prompt_templates", F.explode("samples").alias("s")).select("relation", "prompt_templates", "s.subject", "s.object")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones give a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_lines_slice(spark: SparkSession, path: str, schema: str, *, order: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + limit`` in the order of a column."""
    rows = spark.read.schema(schema).json(path).orderBy(order).offset(start)
    return rows if limit is None else rows.limit(limit)


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """JSON lines, an array, or an object that wraps the records in data, records or examples."""
    if path.endswith((".jsonl", ".ndjson")):
        return json_lines(spark, path, record)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    wrapped = F.from_json("v", f"data array<struct<{_struct(record)}>>, records array<struct<{_struct(record)}>>, examples array<struct<{_struct(record)}>>")
    plain = F.from_json("v", f"array<struct<{_struct(record)}>>")
    either = F.when(F.startswith("v", F.lit("[")), plain).otherwise(F.coalesce(wrapped["data"], wrapped["records"], wrapped["examples"]))
    return text.select(F.explode(either).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str], **options: str) -> DataFrame:
    """CSV with a header, every column a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(header=True, multiLine=True, escape='"', **options).schema(schema).csv(path)


def csv_unicode_escape(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV whose bytes are Latin-1 with backslash escapes."""


    @F.pandas_udf("string")
    def unescaped(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode("latin-1", "backslashreplace").decode("unicode_escape"))

    raw = csv_strings(spark, path, columns, encoding="ISO-8859-1")
    return raw.select(*[unescaped(c).alias(c) for c in columns])


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and types read off the values (an extra pass; give a schema where it is known)."""
    return spark.read.csv(path, header=True, inferSchema=True)


def tsv_with_lists(spark: SparkSession, path: str, columns: Sequence[str], lists: Iterable[str]) -> DataFrame:
    """TSV in which some columns hold list literals with single quotes."""
    raw = csv_strings(spark, path, columns, sep="\t")
    parsed = {c: F.from_json(F.col(c), "array<string>", {"allowSingleQuotes": "true"}) for c in lists}
    return raw.withColumns(parsed)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed line a row, with its file; blank lines dropped."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).where("line <> ''")


def projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def result_folder(spark: SparkSession, glob: str, schema: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Result documents of a folder whose file names hold one of ``include`` and none of ``exclude``; files are left out before they are parsed."""
    name = F.col("_metadata.file_name")
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    keep: Column = F.lit(True)
    if include:
        keep = keep & name.rlike("|".join(map(_literal, include)))
    for x in exclude:
        keep = keep & ~F.contains(name, F.lit(x))
    return rows.where(keep).select("*", name.alias("file"))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def discover_runs(spark: SparkSession, folder: str, file: str, sibling: str, pattern: str) -> DataFrame:
    """Paths of ``file`` in any folder that matches ``pattern`` and also has ``sibling``: path, folder, mi, run."""

    def found(name: str) -> DataFrame:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
        return listing.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))

    rows = found(file).where(F.col("folder").rlike(pattern)).join(found(sibling).select("folder").distinct(), "folder", "left_semi")
    leaf = F.substring_index("folder", "/", -1)
    number = lambda p: F.when(leaf.rlike(p), F.regexp_extract(leaf, p, 1).cast("int"))
    return rows.select("path", "folder", number(r"_mi(\d+)").alias("mi"), number(r"__?run(\d+)$").alias("run"))


def splits(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Several splits of a parquet dataset put together, with the split as a column."""
    from weftline.operators.joins import union_all

    return union_all(*[spark.read.parquet(f"{folder}/{n}").withColumn("split", F.lit(n)) for n in names])


def first_that_loads(*attempts: Callable[[], DataFrame]) -> DataFrame | None:
    """The first source that can be opened; None if none can. Only opening is tried, rows are not read."""
    for attempt in attempts:
        try:
            df = attempt()
            df.schema  # noqa: B018
            return df
        except Exception:  # the next source is tried
            continue
    return None


def max_activations(spark: SparkSession, path: str) -> DataFrame:
    """feature, rank, tokens, acts: the strongest examples of each feature."""
    return spark.read.schema("feature bigint, rank int, tokens array<string>, acts array<double>").parquet(path)


def weights(spark: SparkSession, path: str, renames: dict[str, str], *, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Dictionary rows under their new names, and the rows whose decoder norm isn't 1 within the tolerance."""
    from weftline.functions.vectors import doubles, norm

    rows = spark.read.parquet(path)
    rows = rows.select(*[F.col(c).alias(renames.get(c, c)) for c in rows.columns])
    bad = rows.where(F.abs(norm(doubles(F.col("w_dec"))) - 1) > tolerance)
    return rows, bad


def wide_metrics(spark: SparkSession, path: str, step: str, suffix: str = "train/loss") -> DataFrame:
    """A wide CSV with a column a run to rows (step, run, value); the MIN and MAX columns are left out."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    runs = [c for c in wide.columns if c.endswith(suffix) and not c.endswith(("__MIN", "__MAX"))]
    cast = wide.select(F.col(step).alias("step"), *[F.col(f"`{c}`").cast("double").alias(c) for c in runs])
    return cast.unpivot(["step"], runs, "run", "value").where("value is not null")


def existing_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Names of the files below a folder, without their content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return listing.select(F.substring_index("path", "/", -1).alias("name"), "path", "length")


def image_paths(content: Column) -> Column:
    """Paths of the image parts of a message's content (type, text, image, path): ``image``, else ``path``; none for plain text."""
    parts = F.filter(content, lambda p: p["type"] == "image")
    return F.filter(F.transform(parts, lambda p: F.coalesce(p["image"], p["path"])), lambda x: x.isNotNull())
