"""Corpus statistics, trimming, ordering, splitting, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.operators import order
from weftline.plans.dialect import key, tokens as sql_tokens
from weftline.plans.registry import query
from weftline.ranks import shuffled_rank, upper_median, value_at_rank, value_rank
from weftline.storage import table

WORLD, BATCH, MULTIPLIER = 4, 16, 20


@query(
    "q01_corpus_stats",
    f"""
    with d as (select source, lang, len({sql_tokens('text')}) as n from documents),
    r as (select *, row_number() over (partition by source order by n) as rn, count(*) over (partition by source) as c from d),
    m as (select source, n as upper_median from r where rn = c // 2 + 1)
    select d.source, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens, min(n) as min_len, max(n) as max_len,
      any_value(m.upper_median) as upper_median, round(avg(n), 6) as avg_len,
      round(100.0 * count(*) / sum(count(*)) over (), 6) as pct_docs
    from d join m on m.source = d.source group by d.source""",
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, order statistics and shares by source; medians come off a histogram, so no source is sorted in one task."""
    docs = table(spark, d, "documents").where("source is not null").select("source", F.size(tokens(F.col("text"))).alias("n"))
    medians = value_at_rank(docs, "n", upper_median(), ["source"], name="upper_median").drop("n")
    stats = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.round(F.avg("n"), 6).alias("avg_len")
    )
    pct = F.round(100.0 * F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()), 6)
    return stats.join(medians, "source").withColumn("pct_docs", pct)


@query(
    "q02_percentile_trim",
    """
    with l as (select doc_id, length(text) as len from documents where text is not null),
    t as (select len as threshold from (select len, row_number() over (order by len) as rn, count(*) over () as n from l) where rn = cast(floor((n - 1) * 0.9) as bigint) + 1)
    select doc_id, len, threshold from l, t where len <= threshold""",
)
def percentile_trim(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("len"))
    return order.trim_by_quantile(docs, "len", 0.9)


@query(
    "q03_length_grouped_order",
    f"""
    with s as (select doc_id, coalesce(length(text), 0) as len, row_number() over (order by {key('doc_id', 'mix')}, doc_id) - 1 as ord from documents)
    select doc_id, len, (ord // 320) * 320 + row_number() over (partition by ord // 320 order by len desc, ord) - 1 as new_pos from s""",
)
def length_grouped_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("len"))
    return order.length_grouped(docs, "doc_id", "len", salt="mix", batch=BATCH, multiplier=MULTIPLIER)


@query(
    "q04_strided_shards",
    f"""
    with s as (select doc_id, row_number() over (order by {key('doc_id', 'shard')}, doc_id) as ord, count(*) over () as n from documents)
    select (ord - 1) % 4 as shard, count(*) as n_rows, min(doc_id) as first_id, max(doc_id) as last_id, max((ord - 1) // 4) as last_pos
    from s where ord <= (n // 64) * 64 group by 1""",
)
def strided_shards(spark: SparkSession, d: str) -> DataFrame:
    dealt = order.strided_shards(table(spark, d, "documents").select("doc_id"), "doc_id", WORLD, BATCH, salt="shard")
    return dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("shard_pos").alias("last_pos"))


@query(
    "q05_training_mixture",
    f"""
    with u as (
      select 'documents:' || doc_id as row_key, length(text) as len from documents where text is not null
      union all
      select 'dialogs:' || point_id, sum(coalesce(length(content), 0)) from (
        select distinct point_id, pos, dialog[pos].content as content
        from (select point_id, dialog, unnest(range(1, coalesce(len(dialog), 0) + 1)) as pos from latentqa_datapoints)) group by point_id),
    q as (select len as threshold from (select len, row_number() over (order by len) as rn, count(*) over () as n from u) where rn = cast(floor((n - 1) * 0.999) as bigint) + 1),
    k as (select row_key, cast(len as bigint) as len from u, q where len <= threshold),
    s as (select *, row_number() over (order by {key('row_key', 'mixture')}, row_key) - 1 as ord from k)
    select row_key, len, (ord // 320) * 320 + row_number() over (partition by ord // 320 order by len desc, ord) - 1 as new_pos from s""",
)
def training_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Union of two sources, trimmed at a quantile of length, shuffled and grouped by length."""
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("documents:"), "doc_id").alias("row_key"), F.length("text").cast("bigint").alias("len"))
    turns = table(spark, d, "latentqa_datapoints").where(F.size("dialog") > 0).dropDuplicates(["point_id"])
    chars = F.aggregate("dialog", F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(F.length(t["content"]), F.lit(0)))
    chats = turns.select(F.concat(F.lit("dialogs:"), "point_id").alias("row_key"), chars.alias("len"))
    kept = order.trim_by_quantile(docs.unionByName(chats), "len", 0.999).drop("threshold")
    return order.length_grouped(kept, "row_key", "len", salt="mixture", batch=BATCH, multiplier=MULTIPLIER)


@query(
    "q06_step_schedule",
    """
    with n as (select count(*) // 64 as total from documents),
    s as (select total, total // 10 as warm, unnest(range(0, total)) as step from n)
    select step, round(case when step < warm then step / greatest(warm, 1) else greatest(0.0, (total - step) / greatest(total - warm, 1)) end, 9) as lr_scale,
      step % 10 = 0 as is_eval, step > 0 and step % 25 = 0 as is_save, (step + 1) % 2 = 0 as is_update from s""",
)
def step_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Linear warm-up over a tenth of the steps and linear decay, with the steps that evaluate, save and update."""
    plan = table(spark, d, "documents").agg(F.floor(F.count(F.lit(1)) / (WORLD * BATCH)).alias("total")).withColumn("warm", F.floor(F.col("total") / 10))
    step = F.col("step")
    rising = step / F.greatest(F.col("warm"), F.lit(1))
    falling = F.greatest(F.lit(0.0), (F.col("total") - step) / F.greatest(F.col("total") - F.col("warm"), F.lit(1)))
    return (
        plan.where("total > 0").withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)))
        .select(
            "step", F.round(F.when(step < F.col("warm"), rising).otherwise(falling), 9).alias("lr_scale"),
            (step % 10 == 0).alias("is_eval"), ((step > 0) & (step % 25 == 0)).alias("is_save"), ((step + 1) % 2 == 0).alias("is_update"),
        )
    )


@query(
    "q12_balanced_downsample",
    f"""
    with l as (select distinct sample_id, lower(trim(ds_label, ' ')) as label from context_qa_samples where lower(trim(ds_label, ' ')) in ('true', 'false', 'yes', 'no')),
    r as (select *, row_number() over (partition by label order by {key('sample_id', 'balance')}, sample_id) as rn from l),
    m as (select min(c) as least from (select label, count(*) as c from l group by label))
    select sample_id, label from r, m where rn <= least""",
)
def balanced_downsample(spark: SparkSession, d: str) -> DataFrame:
    label = F.lower(F.trim("ds_label"))
    rows = table(spark, d, "context_qa_samples").select("sample_id", label.alias("label")).where(F.col("label").isin("true", "false", "yes", "no")).distinct()
    return order.balanced(rows, "sample_id", "label", salt="balance")


@query(
    "q13_train_test_split",
    f"""
    with r as (select doc_id, row_number() over (order by {key('doc_id', 'split')}, doc_id) as ord, count(*) over () as n from documents)
    select doc_id, case when ord <= least(600, greatest(n - 100, 0)) then 'train' when ord > n - 100 then 'test' end as split,
      case when ord <= ceil(0.8 * n) then 'a' when ord <= ceil(0.8 * n) + ceil(0.1 * n) then 'b' else 'c' end as part,
      ord <= cast(floor(n * 0.9) as bigint) as first_nine_tenths from r""",
)
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Head and tail of a shuffle, contiguous proportional parts, and a truncated 90/10 cut."""
    docs = table(spark, d, "documents").select("doc_id")
    a = order.head_tail_split(docs, "doc_id", train=600, test=100, salt="split")
    b = order.proportional_split(docs, "doc_id", {"a": 0.8, "b": 0.1, "c": 0.1}, salt="split")
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    cut = shuffled_rank(docs, "doc_id", "split", rank="ord").crossJoin(F.broadcast(total)).select("doc_id", (F.col("ord") <= F.floor(F.col("n") * 0.9)).alias("first_nine_tenths"))
    return a.join(b, "doc_id").join(cut, "doc_id")


@query(
    "q31_stream_interleave",
    """
    with a as (select doc_id as id, row_number() over (order by doc_id) - 1 as ord, count(*) over () as n from documents),
    b as (select point_id as id, row_number() over (order by point_id) - 1 as ord, count(*) over () as n from (select distinct point_id from latentqa_datapoints)),
    k as (select least((select any_value(n) from a) // 3, (select any_value(n) from b)) as cycles)
    select id, 'left' as source, (ord // 3) * 4 + ord % 3 as pos from a, k where ord // 3 < cycles
    union all
    select id, 'right', ord * 4 + 3 from b, k where ord < cycles""",
)
def stream_interleave(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    chats = table(spark, d, "latentqa_datapoints").select(F.col("point_id").alias("id")).distinct()
    return order.interleave(docs, chats, "id", 3, 1)


#: A fold never holds more than an id block's rows of a source; packs run on over the borders and count for the block they begin in.
PACK_CHARS, PACK_BLOCK = 3000, 1 << 12


@query(
    "q32_sequence_packing",
    f"""
    with recursive o as (
      select source, doc_id, cast(coalesce(length(text), 0) as bigint) as n, row_number() over (partition by source order by doc_id) as rn
      from documents where source is not null),
    f as (
      select source, doc_id, rn, n, case when n >= {PACK_CHARS} then 0 else n end as chars, 0 as pack_id, case when n >= {PACK_CHARS} then 1 else 0 end as next_pack from o where rn = 1
      union all
      select o.source, o.doc_id, o.rn, o.n, case when f.chars + o.n >= {PACK_CHARS} then 0 else f.chars + o.n end, f.next_pack,
        f.next_pack + case when f.chars + o.n >= {PACK_CHARS} then 1 else 0 end
      from f join o on o.source = f.source and o.rn = f.rn + 1)
    select source, min(doc_id) // {PACK_BLOCK} as block, pack_id, count(*) as n_docs, cast(sum(n) as bigint) as chars from f group by source, pack_id""",
)
def sequence_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null").withColumn("block", F.floor(F.col("doc_id") / PACK_BLOCK))
    packed = order.pack_greedily(docs, "source", "doc_id", F.coalesce(F.length("text"), F.lit(0)), PACK_CHARS, block="block")
    return packed.groupBy("source", "pack_id").agg(F.min("block").alias("block"), F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("chars")).select("source", "block", "pack_id", "n_docs", "chars")


@query(
    "q07_longest_rows",
    """
    select source, max(length(text)) as longest, min(doc_id) filter (where length(text) = m) as doc_id
    from (select source, doc_id, text, max(length(text)) over (partition by source) as m from documents where source is not null and text is not null) group by source""",
)
def longest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Memory preflight: the longest text of each source and the first row that has it."""
    docs = table(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", F.length("text").alias("len"))
    return docs.groupBy("source").agg(F.max("len").alias("longest"), F.max_by("doc_id", F.struct(F.col("len"), -F.col("doc_id"))).alias("doc_id"))


@query(
    "q08_every_kth",
    """
    select point_id, ord - 1 as pos from (select point_id, row_number() over (order by point_id) as ord from (select distinct point_id from latentqa_datapoints)) where (ord - 1) % 2 = 0""",
)
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "latentqa_datapoints").select("point_id").distinct()
    return value_rank(rows, "point_id", "point_id", rank="ord").where("(ord - 1) % 2 = 0").select("point_id", (F.col("ord") - 1).alias("pos"))
