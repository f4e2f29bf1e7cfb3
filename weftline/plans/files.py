"""Readers, writers and streams, each against the table that it should give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.corpus import PACK_BLOCK, PACK_CHARS
from weftline.plans.dialect import below
from weftline.plans.registry import SQL, query
from weftline.sources import readers, writers
from weftline.storage import step_folder, table
from weftline.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return step_folder(spark, name)


@query("q94_file_round_trips", "select f as format, n_nationkey, n_name from nation, (select unnest(['json_array', 'json_lines', 'csv', 'tsv_list', 'text', 'wrapped', 'map', 'cached']) as f)")
def file_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """The nation table written in eight shapes and read back."""
    base, nation = _folder(spark, "formats"), table(spark, d, "nation").select("n_nationkey", "n_name")
    fields = "n_nationkey int, n_name string"
    one = nation.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # 25 rows
    one.coalesce(1).write.text(base + "/array")
    writers.json_lines(nation, base + "/lines")
    writers.csv(nation, base + "/csv")
    nation.select("n_nationkey", F.concat(F.lit("['"), "n_name", F.lit("']")).alias("names")).write.csv(base + "/tsv", header=True, sep="\t")
    nation.select(F.concat(F.lit("  "), "n_nationkey", F.lit("|"), "n_name", F.lit(" "))).write.text(base + "/text")
    one.select(F.concat(F.lit('{"records": '), "value", F.lit("}"))).coalesce(1).write.text(base + "/wrapped")
    one.select(F.to_json(F.map_from_entries(F.transform(F.from_json("value", f"array<struct<n_nationkey:int,n_name:string>>"), lambda r: F.struct(r["n_nationkey"].cast("string"), F.array(F.array(r["n_name"])))))).alias("value")).coalesce(1).write.text(base + "/map")
    line = readers.lines(spark, base + "/text").select(F.split("line", r"\|").alias("p"))
    frames = {
        "json_array": readers.json_array(spark, base + "/array", fields),
        "json_lines": readers.json_lines_slice(spark, base + "/lines", fields, order="n_nationkey"),
        "csv": readers.csv_inferred(spark, base + "/csv"),
        "tsv_list": readers.tsv_with_lists(spark, base + "/tsv", ["n_nationkey", "names"], ["names"]).select("n_nationkey", F.get("names", F.lit(0)).alias("n_name")),
        "text": line.select(F.get("p", F.lit(0)).alias("n_nationkey"), F.get("p", F.lit(1)).alias("n_name")),
        "wrapped": readers.json_records(spark, base + "/wrapped", fields),
        "map": readers.json_map(spark, base + "/map").select(F.col("label").alias("n_nationkey"), F.col("value")[0][0].alias("n_name")),
        "cached": writers.cached_dataset(spark, base, {"dataset_name": "nation", "batch_size": 4}, "train", lambda: nation),
    }
    from weftline.operators.joins import union_all

    return union_all(*[f.select(F.lit(n).alias("format"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name") for n, f in frames.items()])


@query("q95_stream_pack", SQL["q32_sequence_packing"])
def stream_pack(spark: SparkSession, d: str) -> DataFrame:
    """The packing of q32 as a stateful stream over the table's files."""
    docs = jobs.table_stream(spark, d, "documents").where("source is not null").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    packed = jobs.drain(jobs.packed_stream(docs, ["source"], "doc_id", "size", PACK_CHARS), "packs")
    block = F.min(F.floor(F.col("doc_id") / PACK_BLOCK)).alias("block")
    return packed.groupBy("source", "pack_id").agg(block, F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("chars")).select("source", "block", "pack_id", "n_docs", "chars")


@query(
    "q96_stream_windows",
    "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling daily windows with a watermark over the event stream."""
    counted = jobs.drain(jobs.window_counts(jobs.table_stream(spark, d, "events"), "ts", "event_type", "value", late="60 days"), "windows", mode="update", keys=["start", "event_type"])
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "q109_stream_sessions",
    """
    with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as first from events where user_id is not null),
    s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as nr from e),
    g as (select user_id, min(ts) as start, max(ts) + interval 6 hours as stop, count(*) as n from s group by user_id, nr)
    select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, strftime(stop, '%Y-%m-%d %H:%M:%S') as stop, n from g where stop <= (select max(ts) - interval 2 days from events)""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps under six hours, written once the watermark, two days behind the latest event, has passed them."""
    sessions = jobs.drain(jobs.session_counts(jobs.table_stream(spark, d, "events").where("user_id is not null"), "ts", "user_id", gap="6 hours", late="2 days"), "sessions")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return sessions.select("user_id", shown("start").alias("start"), shown("end").alias("stop"), "n")


@query(
    "q110_sliding_windows",
    """
    with w as (select unnest([0, 1]) as back), e as (select date_trunc('day', ts) - to_days(cast(back as int)) as day, event_type, value from events, w)
    select strftime(day, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from e group by 1, 2""",
)
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days that begin every day, over the event stream."""
    counted = jobs.drain(jobs.window_counts(jobs.table_stream(spark, d, "events"), "ts", "event_type", "value", width="2 days", every="1 day", late="60 days"), "sliding", mode="update", keys=["start", "event_type"])
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


LANES = 8


@query(
    "q97_stream_mix",
    f"""
    with u as (select c_custkey as id, 'left' as source from customer union all select s_suppkey, 'right' from supplier),
    l as (select *, {below('id', 'lane', str(LANES))} as lane from u), o as (select *, row_number() over (partition by source, lane order by id) - 1 as r from l)
    select id, source, (case when source = 'left' then (r // 3) * 4 + r % 3 else r * 4 + 3 end) * {LANES} + lane as pos from o""",
)
def stream_mix(spark: SparkSession, d: str) -> DataFrame:
    """Two streams at 3 to 1, each counted in state by lanes."""
    a = jobs.table_stream(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    b = jobs.table_stream(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return jobs.drain(jobs.mixed_stream(a, b, "id", 3, 1, lanes=LANES), "mixed")


@query("q98_metrics_log", "select cast(user_id as bigint) as user_id, event_type, round(sum(value), 4) as total, cast(user_id % 3 as int) as step from events group by 1, 2, 4")
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """Results of three steps appended to a partitioned log, then read as one table."""
    path = _folder(spark, "log") + "/log"
    totals = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    for step in range(3):
        writers.eval_log(totals.where(F.col("user_id") % 3 == step), path, step)
    return spark.read.parquet(path)
