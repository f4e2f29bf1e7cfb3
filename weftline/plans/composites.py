"""Previews, log-probabilities, sweeps, detection and other composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as seq
from weftline.functions import text
from weftline.operators import evals
from weftline.plans.dialect import below, key, tokens as sql_tokens
from weftline.plans.registry import query
from weftline.plans.scores import _RESP, responses
from weftline.rand import md5_below, md5_key
from weftline.storage import table


@query(
    "q09_preview_per_source",
    """
    with p as (select distinct point_id, source from latentqa_datapoints where source is not null),
    r as (select *, row_number() over (partition by source order by point_id) as n from p) select source, point_id, n from r where n <= 3""",
)
def preview(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each source; the limit is pushed below the shuffle."""
    p = table(spark, d, "latentqa_datapoints").where("source is not null").select("point_id", "source").distinct()
    return p.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("point_id"))).where("n <= 3").select("source", "point_id", "n")


@query(
    "q99_token_logprobs",
    f"""
    with e as (select event_id, [{{token: 'Yes', lp: -({below('event_id', 'lp1', '500')} + 1) / 100.0}}, {{token: 'No', lp: -({below('event_id', 'lp2', '500')} + 1) / 100.0}}, {{token: '?', lp: -({below('event_id', 'lp3', '500')} + 1) / 100.0}}] as l from events),
    s as (select event_id, l, list_filter(l, lambda x: x.token = 'Yes')[1].lp as yes, list_max(list_transform(l, lambda x: x.lp)) as top from e)
    select event_id, round(exp(yes), 9) as p_yes, round(exp(top), 9) as p_top, round(case when yes = top then exp(yes) else 0.0 end, 9) as p_if_first from s""",
)
def token_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities sorted, the probability of a target token, and 0 where it isn't the first."""
    entry = lambda t, salt: F.struct((-(md5_below("event_id", salt, 500) + 1) / 100.0).alias("lp"), F.lit(t).alias("token"))
    e = table(spark, d, "events").select("event_id", F.array(entry("Yes", "lp1"), entry("No", "lp2"), entry("?", "lp3")).alias("l"))
    top = F.array_max(F.transform("l", lambda x: x["lp"]))
    yes = F.get(F.filter("l", lambda x: x["token"] == "Yes"), F.lit(0))["lp"]
    return e.select("event_id", F.round(F.exp(yes), 9).alias("p_yes"), F.round(F.exp(top), 9).alias("p_top"), F.round(F.when(yes == top, F.exp(yes)).otherwise(0.0), 9).alias("p_if_first"))


@query(
    "q100_map_merge",
    """
    with p as (select point_id, any_value(meta_info) as m, any_value(layer) as layer from training_datapoints group by point_id)
    select point_id, cast(layer as varchar) as layer, coalesce(m['run'], 'none') as run, case when m['model_name'] is null then 0 else 1 end + case when m['run'] is null then 0 else 1 end as n_given, array_to_string(list_sort(list_distinct(coalesce(map_keys(m), []) || ['layer', 'run'])), ',') as keys from p""",
)
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Metadata over defaults: the last writer of a key wins."""
    p = table(spark, d, "training_datapoints").dropDuplicates(["point_id"]).select("point_id", "layer", F.coalesce("meta_info", F.create_map().cast("map<string,string>")).alias("m"))
    base = F.create_map(F.lit("layer"), F.col("layer").cast("string"), F.lit("run"), F.lit("none"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(F.col("m"), k))
    merged = p.withColumn("all", F.map_concat("m", kept))
    n = F.map_contains_key("m", "model_name").cast("int") + F.map_contains_key("m", "run").cast("int")
    get = lambda k: F.try_element_at("all", F.lit(k))
    return merged.select("point_id", get("layer").alias("layer"), F.coalesce(get("run"), F.lit("none")).alias("run"), n.alias("n_given"), F.array_join(F.array_sort(F.map_keys("all")), ",").alias("keys"))


@query(
    "q101_date_stamps",
    """
    select event_id, strftime(ts, '%Y%m%d') as day, strftime(ts, '%Y-%m-%d-%H-%M-%S') as stamp, 'events_' || strftime(ts, '%Y%m%d') || '_' || event_type as name from events""",
)
def date_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day = F.date_format("ts", "yyyyMMdd")
    return e.select("event_id", day.alias("day"), F.date_format("ts", "yyyy-MM-dd-HH-mm-ss").alias("stamp"), F.concat(F.lit("events_"), day, F.lit("_"), "event_type").alias("name"))


@query(
    "q102_tries_best",
    f"""
    with r as (select distinct result_id from verbalizer_results), t as (select result_id, unnest(range(1, 6)) as try_number from r),
    s as (select *, {below("result_id || '#' || try_number", 'grade', '7')} / 6.0 as f1 from t),
    b as (select *, row_number() over (partition by result_id order by f1 desc, try_number) as rank from s)
    select result_id, round(f1, 6) as best_f1, try_number, f1 = 1 as perfect from b where rank = 1""",
)
def tries_best(spark: SparkSession, d: str) -> DataFrame:
    """Five tries for each record and the best of them, the earliest on a tie."""
    r = table(spark, d, "verbalizer_results").select("result_id").distinct().withColumn("try_number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))))
    scored = r.withColumn("f1", md5_below(F.concat_ws("#", "result_id", "try_number"), "grade", 7) / 6.0)
    best = evals.best_of(scored, ["result_id"], "f1", "try_number")
    return best.select("result_id", F.round("best", 6).alias("best_f1"), F.col("best_item").alias("try_number"), (F.col("best") == 1).alias("perfect"))


@query(
    "q103_alternate_keys",
    """
    with s as (select distinct sample_id, dataset_name, context, ds_label from context_qa_samples),
    k as (select sample_id, coalesce(nullif(trim(ds_label, ' '), ''), nullif(dataset_name, ''), '(none)') as label, trim(regexp_replace('<image> ' || coalesce(context, '') || ' <IMAGE>', '(?i)[ ]*<image>[ ]*', ' ', 'g'), ' ') as caption from s)
    select sample_id, label, caption, case lower(label) when 'entailment' then 'yes' when 'contradiction' then 'no' when 'neutral' then 'maybe' end as verdict from k""",
)
def alternate_keys(spark: SparkSession, d: str) -> DataFrame:
    """The first non-empty of several fields, markers taken out of text, and labels mapped to verdicts."""
    s = table(spark, d, "context_qa_samples").select("sample_id", "dataset_name", "context", "ds_label").distinct()
    label = F.coalesce(F.nullif(F.trim("ds_label"), F.lit("")), F.nullif("dataset_name", F.lit("")), F.lit("(none)"))
    marked = F.concat(F.lit("<image> "), F.coalesce("context", F.lit("")), F.lit(" <IMAGE>"))
    verdicts = F.create_map(*[F.lit(x) for x in ("entailment", "yes", "contradiction", "no", "neutral", "maybe")])
    return s.select("sample_id", label.alias("label"), F.trim(F.regexp_replace(marked, "(?i)[ ]*<image>[ ]*", " ")).alias("caption")).withColumn("verdict", F.try_element_at(verdicts, F.lower("label")))


@query(
    "q104_patch_prompts",
    f"""
    with d as (select doc_id, {sql_tokens('text')} as t, {below('doc_id', 'patch', '12')} as p from documents)
    select doc_id, array_to_string(t[1 : p + 1], ' ') as source_prompt, case when len(t) > 0 and t[len(t)] like '%x' then lower(left(t[len(t)], length(t[len(t)]) - 1)) else t[len(t)] end as target from d where len(t) > p""",
)
def patch_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens up to and with a place as the prompt; a trailing marker letter of the target is cut and the rest lowered."""
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"), md5_below("doc_id", "patch", 12).cast("int").alias("p")).where("size(t) > p")
    last = F.try_element_at("t", F.lit(-1))
    target = F.when(F.endswith(last, F.lit("x")), F.lower(F.left(last, F.length(last) - 1))).otherwise(last)
    return docs.select("doc_id", F.array_join(seq.py_slice(F.col("t"), 0, F.col("p") + 1), " ").alias("source_prompt"), target.alias("target"))


@query(
    "q105_sweep_table",
    f"""
    with {_RESP}, e as (select result_id % 5 as run, act_key as eval, case when lower(trim(rtrim(response, '.!?,;:'), ' ')) = lower(trim(rtrim(ground_truth, '.!?,;:'), ' ')) then 1.0 else 0.0 end as hit from r where response is not null and ground_truth is not null)
    select 'lr_' || (1 + run) || 'e-5' as run, (1 + run) * 1e-5 as lr, round(avg(hit) filter (where eval = 'lora'), 6) as lora, round(avg(hit) filter (where eval = 'orig'), 6) as orig, round(avg(hit) filter (where eval = 'diff'), 6) as diff, count(*) as n from e group by run""",
)
def sweep_table(spark: SparkSession, d: str) -> DataFrame:
    """A rate read from each run's name, with the accuracy of every evaluation side by side."""
    r = responses(spark, d).where("response is not null and ground_truth is not null")
    run = F.concat(F.lit("lr_"), 1 + F.col("result_id") % 5, F.lit("e-5"))
    hit = text.matches_exactly(F.col("response"), F.col("ground_truth")).cast("double")
    mean = lambda k: F.round(F.avg(F.when(F.col("act_key") == k, F.col("hit"))), 6).alias(k)
    return r.select(run.alias("run"), hit.alias("hit"), "act_key").groupBy("run", F.round(text.learning_rate(F.col("run")), 12).alias("lr")).agg(mean("lora"), mean("orig"), mean("diff"), F.count(F.lit(1)).alias("n"))


@query(
    "q106_detection_pipeline",
    f"""
    with r as (select vec_id, label, row_number() over (partition by label order by {key('vec_id', 'detect')}, vec_id) as ord, count(*) over (partition by label) as n from embeddings),
    t as (select *, vec_id % 2 = 0 as truth from r where n >= 15 and ord <= 12),
    g as (select t.*, m.model, case when {below("vec_id || '#' || model", 'guess', '10')} < model + 6 then truth else not truth end as guess from t, (select unnest([1, 2, 3]) as model) m),
    s as (select label, model, count(*) filter (where guess) as np, count(*) filter (where truth) as nt, count(*) filter (where guess and truth) as hits from g group by 1, 2),
    f as (select *, case when np > 0 then hits / np else 0.0 end as p, case when nt > 0 then hits / nt else 0.0 end as q from s),
    k as (select *, case when p + q > 0 then 2 * p * q / (p + q) else 0.0 end as f1 from f)
    select model, count(*) as n, round(avg(p), 6) as precision, round(avg(q), 6) as recall, round(avg(f1), 6) as f1, count(*) filter (where f1 = 1) as n_perfect, count(*) filter (where round(f1, 9) > 0.8) as n_kept from k group by model""",
)
def detection_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Split, stand-in detection by three models, scores of each feature, and the macro table of each model."""
    from weftline.ranks import shuffled_rank

    rows = table(spark, d, "embeddings").select("vec_id", "label")
    enough = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")
    test = shuffled_rank(rows.join(enough, "label"), "vec_id", "detect", ["label"], rank="ord").where("ord <= 12").withColumn("truth", F.col("vec_id") % 2 == 0)
    judged = test.withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    right = md5_below(F.concat_ws("#", "vec_id", "model"), "guess", 10) < F.col("model") + 6
    judged = judged.withColumn("guess", right == F.col("truth"))
    labels = judged.select("label", "model").distinct()
    scores = evals.set_scores(judged.where("guess"), judged.where("truth"), ["label", "model"], "vec_id", digits=15)
    full = labels.join(scores, ["label", "model"], "left").fillna(0.0, ["precision", "recall", "f1"])
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return full.groupBy("model").agg(F.count(F.lit(1)).alias("n"), mean("precision"), mean("recall"), mean("f1"), F.count_if(F.col("f1") == 1).alias("n_perfect"), F.count_if(F.round("f1", 9) > 0.8).alias("n_kept"))


@query(
    "q107_set_operations",
    """
    with c as (select distinct sample_id, lower(trim(split, ' ')) as split, lower(trim(dataset_name, ' ')) as name from context_qa_samples where split is not null and dataset_name is not null),
    t as (select distinct name from c where split = 'train'), e as (select distinct name from c where split = 'test')
    select 'both' as kind, name from (select name from t intersect select name from e) union all select 'train_only', name from (select name from t except select name from e) union all select 'test_only', name from (select name from e except select name from t)""",
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and both differences of the names in two splits; the subset test is an empty difference."""
    c = table(spark, d, "context_qa_samples").where("split is not null and dataset_name is not null").select(F.lower(F.trim("split")).alias("split"), F.lower(F.trim("dataset_name")).alias("name"))
    t, e = c.where("split = 'train'").select("name"), c.where("split = 'test'").select("name")
    kinds = {"both": t.intersect(e), "train_only": t.exceptAll(t.join(e.distinct(), "name", "left_semi")).distinct(), "test_only": e.subtract(t)}
    from weftline.operators.joins import union_all

    return union_all(*[df.select(F.lit(k).alias("kind"), "name") for k, df in kinds.items()])


@query(
    "q108_priority_order",
    f"""
    with c as (select distinct config_id, lower(trim(dataset_name, ' ')) as name, num_train from dataset_loader_configs)
    select name, row_number() over (order by case when name like '%truth%' then 0 when name like 'classification%' then 1 else 2 end, num_train desc, config_id) as place, {key('config_id', 'p')} as tag from c""",
)
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows placed by a custom priority, then by size. The config table is of fixed size, so one window is enough."""
    c = table(spark, d, "dataset_loader_configs").select("config_id", F.lower(F.trim("dataset_name")).alias("name"), "num_train").distinct()
    rank = F.when(F.contains("name", F.lit("truth")), 0).when(F.startswith("name", F.lit("classification")), 1).otherwise(2)
    return c.select("name", F.row_number().over(Window.orderBy(rank, F.desc("num_train"), "config_id")).alias("place"), md5_key("config_id", "p").alias("tag"))
