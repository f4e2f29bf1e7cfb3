"""Tables behind comparisons of models: progression, diversity, layers, knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import stats, text
from weftline.operators import joins
from weftline.plans.registry import query
from weftline.plans.scores import _RESP, responses
from weftline.storage import table

#: Which evaluation a prompt belongs to, by how it begins; the first that fits.
EVALS = [("classification", "Is "), ("classification", "Does "), ("taboo", "Which word"), ("taboo", "Which single"), ("secret", "What secret"), ("gender", "Would "), ("persona", "")]

#: Model types in the order in which they build on each other.
PROGRESSION = ["oracle_f", "oracle_e", "oracle_d", "oracle_b", "oracle_a"]

_EVAL = "case " + " ".join(f"when starts_with(verbalizer_prompt, '{p}') then '{e}'" for e, p in EVALS) + " end"
_MODEL = "coalesce(regexp_extract(verbalizer_lora_path, '([^/]*)_[0-9]+$', 1), 'base_model')"
_LAYER = "cast(nullif(regexp_extract(verbalizer_lora_path, '_([0-9]+)$', 1), '') as int)"
_HIT = "case when contains(trim(lower(response), ' '), trim(lower(ground_truth), ' ')) then 1.0 else 0.0 end"
_JUDGED = f"""{_RESP},
j as (select result_id, act_key, {_EVAL} as eval, {_MODEL} as model, {_LAYER} as layer, {_HIT} as hit, target_lora_path, response from r where response is not null and ground_truth is not null and verbalizer_prompt is not null)
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """A row for each response with a known truth: result_id, act_key, eval, model, layer, hit, target_lora_path, response."""
    r = responses(spark, d).where("response is not null and ground_truth is not null and verbalizer_prompt is not null")
    kind = F.coalesce(*[F.when(F.startswith("verbalizer_prompt", F.lit(p)), e) for e, p in EVALS])
    name = text.last_segment(F.col("verbalizer_lora_path"))
    layer = F.regexp_extract(name, "_([0-9]+)$", 1)
    hit = text.contains_answer(F.col("response"), F.col("ground_truth")).cast("double")
    return r.select("result_id", "act_key", kind.alias("eval"), F.regexp_replace(name, "_[0-9]+$", "").alias("model"), F.nullif(layer, F.lit("")).cast("int").alias("layer"), hit.alias("hit"), "target_lora_path", "response")


def record_scores(rows: DataFrame, *group: str) -> DataFrame:
    """The share of hits of each record."""
    return rows.groupBy("result_id", *group).agg(F.avg("hit").alias("score"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


_ORDER = ", ".join(f"'{m}'" for m in PROGRESSION)


@query(
    "q119_model_progression",
    f"""
    with {_JUDGED}, s as (select result_id, model, eval, avg(hit) as score from j where act_key = 'lora' group by 1, 2, 3),
    m as (select model, eval, count(*) as n, avg(score) as mean, 1.96 * stddev_samp(score) / sqrt(count(*)) as margin from s group by 1, 2),
    o as (select *, list_position([{_ORDER}], model) - 1 as step from m where model in ({_ORDER}))
    select step, model, eval, n, round(mean, 6) as mean, round(margin, 6) as margin, round(avg(mean) over (partition by model), 6) as model_mean,
      round(mean - lag(mean) over (partition by eval order by step), 6) as gain from o""",
)
def model_progression(spark: SparkSession, d: str) -> DataFrame:
    """Five evaluations of the model types in their order: mean over records with margin, the mean over evaluations and the gain on the type before that has the evaluation. Other types are left out."""
    scored = record_scores(judged(spark, d).where("act_key = 'lora'").where(F.col("model").isin(PROGRESSION)), "model", "eval")
    m = scored.groupBy("model", "eval").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), stats.mean_margin(F.col("score")).alias("margin"))
    order = F.array_position(F.array(*map(F.lit, PROGRESSION)), F.col("model")) - 1
    stepped = m.withColumn("step", order)
    before = F.lag("mean").over(Window.partitionBy("eval").orderBy("step"))  # at most five rows an evaluation
    return stepped.select("step", "model", "eval", "n", r6(F.col("mean")).alias("mean"), r6(F.col("margin")).alias("margin"), r6(F.avg("mean").over(Window.partitionBy("model"))).alias("model_mean"), r6(F.col("mean") - before).alias("gain"))


@query(
    "q120_diversity_panels",
    f"""
    with {_JUDGED}, k as (select * from j where layer = 50 and eval in ('classification', 'persona', 'taboo') and (eval = 'classification' or act_key = 'lora')),
    c as (select 'classification' as panel, model, count(*) as n, avg(hit) as mean, 1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*)) as margin from k where eval = 'classification' group by model),
    s as (select eval, model, result_id, avg(hit) as score from k where eval <> 'classification' group by 1, 2, 3),
    o as (select eval as panel, model, count(*) as n, avg(score) as mean, 1.96 * stddev_samp(score) / sqrt(count(*)) as margin from s group by 1, 2),
    u as (select * from c union all select * from o)
    select panel, model, n, round(mean, 6) as mean, round(margin, 6) as margin, rank() over (partition by panel order by round(mean, 6) desc) as place from u""",
)
def diversity_panels(spark: SparkSession, d: str) -> DataFrame:
    """Three panels side by side for the adapters whose name holds a given layer: a share of answers with a binomial margin, and two means over records; ranked within each panel."""
    rows = judged(spark, d).where("layer = 50")
    c = rows.where("eval = 'classification'").groupBy(F.col("eval").alias("panel"), "model").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("mean"))
    c = c.withColumn("margin", stats.Z * stats.binomial_error(F.col("mean"), F.col("n")))
    o = record_scores(rows.where("eval in ('persona', 'taboo') and act_key = 'lora'"), "eval", "model").groupBy(F.col("eval").alias("panel"), "model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), stats.mean_margin(F.col("score")).alias("margin"))
    u = joins.union_all(c, o).select("panel", "model", "n", r6(F.col("mean")).alias("mean"), r6(F.col("margin")).alias("margin"))
    return u.withColumn("place", F.rank().over(Window.partitionBy("panel").orderBy(F.desc("mean"))).cast("bigint"))


@query(
    "q121_layer_comparison",
    f"""
    with {_JUDGED}, s as (select model, layer, eval, result_id, avg(hit) as score from j where layer in (25, 75) group by 1, 2, 3, 4),
    m as (select model, eval, count(*) filter (where layer = 25) as n_first, count(*) filter (where layer = 75) as n_second, avg(score) filter (where layer = 25) as a, avg(score) filter (where layer = 75) as b,
      1.96 * stddev_samp(score) filter (where layer = 25) / sqrt(count(*) filter (where layer = 25)) as am, 1.96 * stddev_samp(score) filter (where layer = 75) / sqrt(count(*) filter (where layer = 75)) as bm from s group by 1, 2)
    select model, eval, n_first, n_second, round(a, 6) as first_mean, round(am, 6) as first_margin, round(b, 6) as second_mean, round(bm, 6) as second_margin, round(b - a, 6) as difference, coalesce(abs(b - a) > am + bm, false) as is_apart from m""",
)
def layer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of each model side by side by evaluation, with margins and whether the intervals lie apart."""
    s = record_scores(judged(spark, d).where("layer in (25, 75)"), "model", "layer", "eval")
    of = lambda layer: F.when(F.col("layer") == layer, F.col("score"))
    m = s.groupBy("model", "eval").agg(
        F.count(of(25)).alias("n_first"), F.count(of(75)).alias("n_second"), F.avg(of(25)).alias("a"), F.avg(of(75)).alias("b"),
        F.when(F.count(of(25)) > 0, stats.mean_margin(of(25))).alias("am"), F.when(F.count(of(75)) > 0, stats.mean_margin(of(75))).alias("bm"),
    )
    gap = F.col("b") - F.col("a")
    return m.select(
        "model", "eval", "n_first", "n_second", r6(F.col("a")).alias("first_mean"), r6(F.col("am")).alias("first_margin"), r6(F.col("b")).alias("second_mean"), r6(F.col("bm")).alias("second_margin"),
        r6(gap).alias("difference"), F.coalesce(F.abs(gap) > F.col("am") + F.col("bm"), F.lit(False)).alias("is_apart"),
    )


@query(
    "q122_knowledge_eval",
    f"""
    with {_JUDGED}, k as (select eval as attribute, case when target_lora_path is null then 'base_model' else 'persona_lora' end as model, hit from j),
    g as (select attribute, model, count(*) as total_count, 100.0 * avg(hit) as overall_accuracy from k group by 1, 2),
    a as (select *, overall_accuracy / 100.0 as p from g)
    select attribute, model, total_count, round(p, 6) as accuracy, round(1.96 * sqrt(greatest(p * (1 - p), 0.0) / total_count), 6) as margin,
      round(p - max(case when model = 'base_model' then p end) over (partition by attribute), 6) as over_base from a""",
)
def knowledge_eval(spark: SparkSession, d: str) -> DataFrame:
    """What the base model and the tuned one know, by attribute: percentages to shares, binomial margins and the gain over the base."""
    model = F.when(F.col("target_lora_path").isNull(), "base_model").otherwise("persona_lora")
    g = judged(spark, d).groupBy(F.col("eval").alias("attribute"), model.alias("model")).agg(F.count(F.lit(1)).alias("total_count"), (100.0 * F.avg("hit")).alias("overall_accuracy"))
    a = g.withColumn("p", F.col("overall_accuracy") / 100.0)
    base = F.max(F.when(F.col("model") == "base_model", F.col("p"))).over(Window.partitionBy("attribute"))
    margin = stats.Z * F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(0.0)) / F.col("total_count"))
    return a.select("attribute", "model", "total_count", r6(F.col("p")).alias("accuracy"), r6(margin).alias("margin"), r6(F.col("p") - base).alias("over_base"))


#: Sets outside the training distribution by how their names begin: here with the headline sets, which the later tables leave out.
OUTSIDE = ["truth_", "relation_", "headline_is_"]


@query(
    "q123_outside_with_headlines",
    f"""
    with c as (select distinct datapoint_id, dataset_name, target_response from classification_datapoints where dataset_name is not null and target_response is not null),
    k as (select *, {' or '.join(f"starts_with(dataset_name, '{p}')" for p in OUTSIDE)} as is_outside, case when lower(trim(target_response, ' ')) like 'yes%' then 1.0 else 0.0 end as hit from c)
    select case when is_outside then 'outside' else 'inside' end as part, split_part(dataset_name, '_', 1) as family, count(distinct dataset_name) as n_sets, count(*) as n, round(avg(hit), 6) as micro,
      round(1.96 * sqrt(avg(hit) * (1 - avg(hit)) / count(*)), 6) as margin from k group by 1, 2""",
)
def outside_with_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by family of sets under the longer list of sets outside the training distribution."""
    rows = table(spark, d, "classification_datapoints").where("dataset_name is not null and target_response is not null").select("datapoint_id", "dataset_name", "target_response").distinct()
    outside = F.lit(False)
    for p in OUTSIDE:
        outside = outside | F.startswith("dataset_name", F.lit(p))
    hit = F.startswith(F.lower(F.trim("target_response")), F.lit("yes")).cast("double")
    k = rows.select(F.when(outside, "outside").otherwise("inside").alias("part"), F.split_part("dataset_name", F.lit("_"), F.lit(1)).alias("family"), "dataset_name", hit.alias("hit"))
    by_set = k.groupBy("part", "family", "dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))  # a set is one row before families are added up
    g = by_set.groupBy("part", "family").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("p", F.col("hits") / F.col("n"))
    return g.select("part", "family", "n_sets", "n", r6(F.col("p")).alias("micro"), r6(stats.Z * stats.binomial_error(F.col("p"), F.col("n"))).alias("margin"))
