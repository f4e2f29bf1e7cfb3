"""Scores, intervals and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import stats, text
from weftline.operators import evals, joins
from weftline.plans.dialect import below
from weftline.plans.registry import query
from weftline.rand import md5_below
from weftline.storage import table

_NORMAL = "lower(trim(rtrim({}, '.!?,;:'), ' '))"
_RESP = """
r as (select result_id, verbalizer_lora_path, target_lora_path, act_key, verbalizer_prompt, ground_truth, i - 1 as i, full_sequence_responses[i] as response
  from (select *, unnest(range(1, coalesce(len(full_sequence_responses), 0) + 1)) as i from
    (select distinct result_id, verbalizer_lora_path, target_lora_path, act_key, verbalizer_prompt, ground_truth, full_sequence_responses from verbalizer_results)))
"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """One row a response, each result once."""
    cols = ["result_id", "verbalizer_lora_path", "target_lora_path", "act_key", "verbalizer_prompt", "ground_truth"]
    rows = table(spark, d, "verbalizer_results").select(*cols, "full_sequence_responses").distinct()
    return rows.select(*cols, F.posexplode("full_sequence_responses").alias("i", "response"))


def _interval_sql(inner: str, group: str) -> str:
    return f"""
    select {group}, n, correct, round(p, 6) as accuracy, round(case when n > 0 then sqrt(p * (1 - p) / n) else 0.0 end, 6) as se,
      round(greatest(0.0, p - 1.96 * case when n > 0 then sqrt(p * (1 - p) / n) else 0.0 end), 6) as lo,
      round(case when n > 0 then least(1.0, p + 1.96 * sqrt(p * (1 - p) / n)) else 0.0 end, 6) as hi
    from (select *, case when n > 0 then correct / n else 0.0 end as p from ({inner}))"""


@query(
    "q60_score_responses",
    f"""
    with {_RESP}
    select act_key, count(*) as n, round(avg(case when {_NORMAL.format('response')} in ('yes', 'no') then 100.0 else 0.0 end), 6) as format_pct,
      round(avg(case when {_NORMAL.format('response')} = {_NORMAL.format('ground_truth')} then 100.0 else 0.0 end), 6) as answer_pct,
      round(avg(case when contains(trim(lower(response), ' '), trim(lower(ground_truth), ' ')) then 100.0 else 0.0 end), 6) as contains_pct
    from r where response is not null and ground_truth is not null group by act_key""",
)
def score_responses(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d).where("response is not null and ground_truth is not null")
    pct = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 6)
    a, t = F.col("response"), F.col("ground_truth")
    return r.groupBy("act_key").agg(F.count(F.lit(1)).alias("n"), pct(text.is_yes_no(a)).alias("format_pct"), pct(text.matches_exactly(a, t)).alias("answer_pct"), pct(text.contains_answer(a, t)).alias("contains_pct"))


@query("q61_binomial_ci", _interval_sql("select dataset_name, count(*) as n, count(*) filter (where lower(trim(target_response, ' ')) = 'yes') as correct from (select distinct datapoint_id, dataset_name, target_response from classification_datapoints) group by dataset_name", "dataset_name"))
def binomial_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "classification_datapoints").select("datapoint_id", "dataset_name", "target_response").distinct()
    return evals.score_table(rows, ["dataset_name"], F.lower(F.trim("target_response")) == "yes")


@query(
    "q62_mean_ci_two_level",
    """
    select event_type, cast(user_id % 10 as bigint) as bucket, round(avg(value), 6) as mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) as margin, count(value) as n, grouping(user_id % 10) as is_total
    from events group by grouping sets ((event_type, user_id % 10), (event_type))""",
)
def mean_ci(spark: SparkSession, d: str) -> DataFrame:
    return evals.two_level_means(table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10), "event_type", "bucket", "value")


@query(
    "q63_micro_macro",
    f"""
    with {_RESP}, b as (select verbalizer_lora_path as g, count(*) as n, avg(case when {_NORMAL.format('response')} = {_NORMAL.format('ground_truth')} then 1.0 else 0.0 end) as acc from r where response is not null and ground_truth is not null group by 1)
    select round(sum(acc * n) / sum(n), 6) as micro, round(avg(acc), 6) as macro, round(stddev_pop(acc), 6) as macro_std, round(sum(acc * n) / sum(n), 6) as weighted, count(*) as n_groups from b""",
)
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d).where("response is not null and ground_truth is not null")
    return evals.micro_macro(r, "verbalizer_lora_path", text.matches_exactly(F.col("response"), F.col("ground_truth")))




@query(
    "q64_iid_ood_table",
    f"""
    with c as (select distinct datapoint_id, dataset_name, target_response from classification_datapoints where dataset_name is not null),
    g as (select *, case when dataset_name like '%truth%' then 'ood' when dataset_name like '%relation%' then 'ood' else 'iid' end as split, case when dataset_name like '%truth%' then 1 when dataset_name like '%relation%' then 2 else 0 end as priority from c)
    select split, dataset_name, any_value(priority) as priority, count(*) as n, round(avg(case when target_response = 'Yes' then 1.0 else 0.0 end), 6) as accuracy,
      round(1.96 * sqrt(avg(case when target_response = 'Yes' then 1.0 else 0.0 end) * (1 - avg(case when target_response = 'Yes' then 1.0 else 0.0 end)) / count(*)), 6) as margin,
      round(avg(avg(case when target_response = 'Yes' then 1.0 else 0.0 end)) over (partition by split), 6) as split_mean
    from g group by split, dataset_name""",
)
def iid_ood(spark: SparkSession, d: str) -> DataFrame:
    """Groups from name lists, a display priority, per-set accuracy with margin and the unweighted mean of each split."""
    rows = table(spark, d, "classification_datapoints").where("dataset_name is not null").select("datapoint_id", "dataset_name", "target_response").distinct()
    truth, relation = F.contains("dataset_name", F.lit("truth")), F.contains("dataset_name", F.lit("relation"))
    g = rows.withColumn("split", F.when(truth | relation, "ood").otherwise("iid")).withColumn("priority", F.when(truth, 1).when(relation, 2).otherwise(0))
    hit = F.coalesce(F.col("target_response") == "Yes", F.lit(False)).cast("double")
    by = g.groupBy("split", "dataset_name").agg(F.first("priority").alias("priority"), F.count(F.lit(1)).alias("n"), F.avg(hit).alias("p"))
    margin = 1.96 * stats.binomial_error(F.col("p"), F.col("n"))
    return by.select("split", "dataset_name", "priority", "n", F.round("p", 6).alias("accuracy"), F.round(margin, 6).alias("margin"), F.round(F.avg("p").over(Window.partitionBy("split")), 6).alias("split_mean"))


@query(
    "q65_word_classes",
    r"""
    with d as (select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])features?([^a-z0-9_]|$)') as a, regexp_matches(lower(text), '(^|[^a-z0-9_])models?([^a-z0-9_]|$)') as b from documents where text is not null)
    select case when a and b then 'both' when a then 'feature' when b then 'model' else 'neither' end as class, count(*) as n from d group by 1""",
)
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(text.word_class(F.col("text"), "feature", "model").alias("class"))
    return docs.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


SYNONYMS = {"yes": ["yes", "yeah", "correct"], "no": ["no", "nope", "incorrect"]}


@query(
    "q66_synonym_match",
    f"""
    with {_RESP}, k as (select *, case when lower(ground_truth) = 'yes' then ['yes', 'yeah', 'correct'] when lower(ground_truth) = 'no' then ['no', 'nope', 'incorrect'] end as accepted,
      case when lower(ground_truth) = 'yes' then 'no' else 'yes' end as opposite from r where lower(ground_truth) in ('yes', 'no') and response is not null)
    select act_key, count(*) as n, count(*) filter (where len(list_filter(accepted, lambda a: contains(lower(response), lower(a)))) > 0) as any_synonym,
      count(*) filter (where contains(trim(lower(response), ' '), trim(lower(ground_truth), ' ')) and not contains(trim(lower(response), ' '), opposite)) as exclusive from k group by act_key""",
)
def synonym_match(spark: SparkSession, d: str) -> DataFrame:
    """Accepted spellings from a small table, and the rule that the opposite must be absent."""
    syn = spark.createDataFrame(list(SYNONYMS.items()), "truth string, accepted array<string>")
    r = responses(spark, d).where("response is not null").withColumn("truth", F.lower("ground_truth")).join(F.broadcast(syn), "truth")
    opposite = F.when(F.col("truth") == "yes", "no").otherwise("yes")
    return r.groupBy("act_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text.contains_any(F.col("response"), F.col("accepted"))).alias("any_synonym"),
        F.count_if(text.contains_exclusively(F.col("response"), F.col("ground_truth"), opposite)).alias("exclusive"),
    )


@query(
    "q68_best_of_n",
    """
    with e as (select user_id, event_type, event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) * 0.1 + value as score from events)
    select user_id, event_type, round(max(score), 6) as best, min(event_id) filter (where score = m) as best_item, count(*) as n from (select *, max(score) over (partition by user_id, event_type) as m from e) group by 1, 2""",
)
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    """A score parsed with a fall-back, the best of a record's tries and which it was."""
    score = text.int_or_zero(F.get_json_object("props", "$.k")) * 0.1 + F.col("value")
    best = evals.best_of(table(spark, d, "events").withColumn("score", score), ["user_id", "event_type"], "score", "event_id")
    return best.withColumn("best", F.round("best", 6))


@query(
    "q70_conditional_pivot",
    """
    select o_orderpriority, round(avg(case when o_orderstatus = 'O' then o_totalprice end), 4) as open_mean, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as filled_mean, round(avg(o_totalprice), 4) as all_mean,
      count(*) filter (where o_orderstatus = 'O') as n_open, count(*) filter (where o_orderstatus = 'F') as n_filled, count(*) as n from orders group by 1""",
)
def conditional_pivot(spark: SparkSession, d: str) -> DataFrame:
    is_open, is_filled = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    mean = lambda c: F.round(F.avg(F.when(c, F.col("o_totalprice"))), 4)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        mean(is_open).alias("open_mean"), mean(is_filled).alias("filled_mean"), F.round(F.avg("o_totalprice"), 4).alias("all_mean"),
        F.count_if(is_open).alias("n_open"), F.count_if(is_filled).alias("n_filled"), F.count(F.lit(1)).alias("n"),
    )


@query(
    "q71_agent_grades",
    """
    with b as (select l_returnflag, l_linestatus, l_suppkey, max(l_quantity * (1 - l_discount)) as grade from lineitem group by 1, 2, 3)
    select l_returnflag, l_linestatus, round(max(grade), 6) as max, round(min(grade), 6) as min, round(median(grade), 6) as median, round(avg(grade), 6) as mean, round(stddev_pop(grade), 6) as std_pop, count(grade) as n from b group by 1, 2""",
)
def agent_grades(spark: SparkSession, d: str) -> DataFrame:
    """The best run of each agent, then the spread over agents by every aggregator."""
    best = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.max(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("grade"))
    return evals.aggregate_as(best, ["l_returnflag", "l_linestatus"], "grade")


@query(
    "q72_unpivot_trailing_mean",
    """
    with w as (select user_id as step, max(value) filter (where event_type = 'click') as click, max(value) filter (where event_type = 'view') as view, max(value) filter (where event_type = 'purchase') as purchase from events group by 1),
    l as (select step, 'lr_1e-5' as run, click as loss from w union all select step, 'lr_3e-5', view from w union all select step, 'base', purchase from w),
    r as (select *, row_number() over (partition by run order by step desc) as back from l where loss is not null)
    select run, case when regexp_extract(run, 'lr_(\\d+e-?\\d+)', 1) <> '' then cast(regexp_extract(run, 'lr_(\\d+e-?\\d+)', 1) as double) else 1e-5 end as lr, round(avg(loss), 6) as trailing_mean, count(*) as n from r where back <= 200 group by 1, 2""".replace("\\\\", "\\"),
)
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    """Wide metrics to long, then the mean of the last 200 values of each run; the rate is read from the run's name."""
    e = table(spark, d, "events")
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    wide = e.groupBy(F.col("user_id").alias("step")).agg(of("click").alias("lr_1e-5"), of("view").alias("lr_3e-5"), of("purchase").alias("base"))
    long = wide.unpivot(["step"], ["lr_1e-5", "lr_3e-5", "base"], "run", "loss").where("loss is not null")
    from weftline.ranks import value_rank

    last = value_rank(long, "step", "step", ["run"], descending=True, rank="back").where("back <= 200")
    return last.groupBy("run", text.learning_rate(F.col("run")).alias("lr")).agg(F.round(F.avg("loss"), 6).alias("trailing_mean"), F.count(F.lit(1)).alias("n"))


@query(
    "q83_merge_partials",
    """
    with c as (select distinct datapoint_id, dataset_name, target_response from classification_datapoints)
    select coalesce(dataset_name, '(none)') as dataset_name, cast(count(*) filter (where target_response = 'Yes') as bigint) as correct, count(*) as n, round(count(*) filter (where target_response = 'Yes') / count(*), 6) as accuracy from c group by 1""",
)
def merge_partials(spark: SparkSession, d: str) -> DataFrame:
    """Counts made apart for three parts of the data, then added up."""
    rows = table(spark, d, "classification_datapoints").select("datapoint_id", F.coalesce("dataset_name", F.lit("(none)")).alias("dataset_name"), "target_response").distinct()
    parts = [rows.where(F.pmod("datapoint_id", F.lit(3)) == i).groupBy("dataset_name").agg(F.count_if(F.col("target_response") == "Yes").alias("correct"), F.count(F.lit(1)).alias("n")) for i in range(3)]
    merged = evals.merged_counts(parts, ["dataset_name"])
    return merged.withColumn("accuracy", F.round(stats.share(F.col("correct"), F.col("n")), 6))


@query(
    "q84_verbalizer_summary",
    f"""
    with {_RESP}
    select act_key, coalesce(regexp_extract(target_lora_path, '([^/]*)$', 1), 'base_model') as target, count(*) as n, count(distinct {_NORMAL.format('response')}) as n_distinct,
      count(*) filter (where contains(lower(response), 'yes')) as n_yes, count(*) filter (where response is null) as n_null from r group by 1, 2""",
)
def verbalizer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hit counts and distinct normalised answers by activation source and target; a missing target is the base model."""
    r = responses(spark, d)
    return r.groupBy("act_key", text.last_segment(F.col("target_lora_path")).alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(text.normalise_answer(F.col("response"))).alias("n_distinct"),
        F.count_if(F.contains(F.lower("response"), F.lit("yes"))).alias("n_yes"), F.count_if(F.col("response").isNull()).alias("n_null"),
    )


@query(
    "q85_token_vs_sequence",
    """
    with v as (select distinct result_id, verbalizer_lora_path, ground_truth, token_responses, full_sequence_responses, segment_responses from verbalizer_results where ground_truth is not null),
    x as (
      select verbalizer_lora_path, 'token' as kind, result_id, max(case when coalesce(contains(lower(r), lower(ground_truth)), false) then 1.0 else 0.0 end) as hit from (select *, unnest(token_responses) as r from v) group by 1, 2, 3
      union all select verbalizer_lora_path, 'sequence', result_id, avg(case when coalesce(contains(lower(r), lower(ground_truth)), false) then 1.0 else 0.0 end) from (select *, unnest(full_sequence_responses) as r from v) group by 1, 2, 3
      union all select verbalizer_lora_path, 'segment', result_id, avg(case when coalesce(contains(lower(r), lower(ground_truth)), false) then 1.0 else 0.0 end) from (select *, unnest(segment_responses) as r from v) group by 1, 2, 3)
    select verbalizer_lora_path, kind, round(avg(hit), 6) as mean, round(1.96 * stddev_samp(hit) / sqrt(count(hit)), 6) as margin, count(*) as n from x group by 1, 2""",
)
def token_vs_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Best of the token answers beside the mean of segment and sequence answers, with margins over records."""
    cols = {"token": "token_responses", "sequence": "full_sequence_responses", "segment": "segment_responses"}
    v = table(spark, d, "verbalizer_results").where("ground_truth is not null").select("result_id", "verbalizer_lora_path", "ground_truth", *cols.values()).distinct()
    hit = lambda r: F.when(F.coalesce(F.contains(F.lower(r), F.lower("ground_truth")), F.lit(False)), 1.0).otherwise(0.0)

    def part(kind: str) -> DataFrame:
        hits = F.transform(cols[kind], hit)
        mean = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x) / F.size(hits)
        return v.where(F.size(cols[kind]) > 0).select("verbalizer_lora_path", F.lit(kind).alias("kind"), (F.array_max(hits) if kind == "token" else mean).alias("hit"))

    rows = joins.union_all(*[part(k) for k in cols])
    return rows.groupBy("verbalizer_lora_path", "kind").agg(F.round(F.avg("hit"), 6).alias("mean"), F.round(stats.mean_margin(F.col("hit")), 6).alias("margin"), F.count(F.lit(1)).alias("n"))


@query(
    "q86_votes",
    f"""
    with {_RESP}, v as (select result_id, {_NORMAL.format('response')} as a, i from r where response is not null and trim(response, ' ') <> ''),
    c as (select result_id, a, count(*) as votes, min(i) as first from v group by 1, 2),
    k as (select *, row_number() over (partition by result_id order by votes desc, first) as rank from c)
    select result_id, a as winner, votes from k where rank = 1""",
)
def votes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent answer of each record, the first given on a tie; records without answers are dropped."""
    v = responses(spark, d).where("response is not null and trim(response) <> ''").select("result_id", text.normalise_answer(F.col("response")).alias("a"), "i")
    c = v.groupBy("result_id", "a").agg(F.count(F.lit(1)).alias("votes"), F.min("i").alias("first"))
    return c.groupBy("result_id").agg(F.max_by(F.struct("a", "votes"), F.struct(F.col("votes"), -F.col("first"))).alias("w")).select("result_id", F.col("w.a").alias("winner"), F.col("w.votes").alias("votes"))


@query(
    "q87_uniform_schema",
    """
    select dataset_name, count(*) as n, min(len(questions)) as least, max(len(questions)) as most, min(len(questions)) = max(len(questions)) and min(len(answers)) = max(len(answers)) as is_uniform
    from (select distinct sample_id, dataset_name, questions, answers from context_qa_samples where dataset_name is not null) group by 1""",
)
def uniform_schema(spark: SparkSession, d: str) -> DataFrame:
    """Min = max over each group, as a report."""
    rows = table(spark, d, "context_qa_samples").where("dataset_name is not null").select("sample_id", "dataset_name", "questions", "answers").distinct()
    big = lambda c: c.cast("bigint")
    nq, na = F.size("questions"), F.size("answers")
    return rows.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), big(F.min(nq)).alias("least"), big(F.max(nq)).alias("most"), ((F.min(nq) == F.max(nq)) & (F.min(na) == F.max(na))).alias("is_uniform"))


@query(
    "q88_seeded_runs",
    f"""
    with e as (select event_id, event_type, value, {below('event_id', 'run', '4')} as run from events)
    select event_type, run, round(avg(value), 6) as mean, count(*) as n from e group by 1, 2""",
)
def seeded_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records dealt to tries by a keyed hash, then averaged by try."""
    return table(spark, d, "events").groupBy("event_type", md5_below("event_id", "run", 4).alias("run")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


