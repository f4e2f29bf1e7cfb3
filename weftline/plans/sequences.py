"""Token windows, conversations, masks, padding, probes and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as seq
from weftline.functions.text import tokens
from weftline.operators import joins
from weftline.plans.dialect import TURNS, below, int32, tokens as sql_tokens
from weftline.plans.registry import query
from weftline.rand import md5_below, md5_int
from weftline.storage import table


def dialogs(spark: SparkSession, d: str) -> DataFrame:
    """point_id and dialog, each record once, without null and empty dialogs."""
    return table(spark, d, "latentqa_datapoints").where("size(dialog) > 0").select("point_id", "label", "source", "read_prompt", "dialog").dropDuplicates(["point_id"])


def turns(spark: SparkSession, d: str) -> DataFrame:
    return dialogs(spark, d).select("point_id", F.posexplode("dialog").alias("pos", "t")).select("point_id", "pos", "t.role", "t.content")


@query(
    "q21_entity_spans",
    f"""
    with d as (select doc_id, {sql_tokens('text')} as toks from documents),
    e as (select doc_id, unnest(range(1, len(toks) + 1)) as pos, toks from d),
    t as (select doc_id, pos, toks[pos] as tok, regexp_matches(toks[pos], '^[A-Z]') as ent from e),
    f as (select *, case when ent and not coalesce(lag(ent) over (partition by doc_id order by pos), false) then 1 else 0 end as start_flag from t),
    g as (select *, sum(start_flag) over (partition by doc_id order by pos) as span_no from f)
    select doc_id, cast(span_no as bigint) as span_no, min(pos) - 1 as begin_pos, string_agg(tok, ' ' order by pos) as entity from g where ent group by doc_id, span_no""",
)
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and islands: runs of capitalised tokens become entities, within the row of their document."""
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("toks"))
    flags = docs.select("doc_id", "toks", F.transform("toks", lambda t: t.rlike("^[A-Z]")).alias("ent"))
    at = lambda i: F.coalesce(F.get("ent", i), F.lit(False))
    begins = F.filter(F.transform("ent", lambda e, i: F.when(e & ~at(i - 1), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("ent", lambda e, i: F.when(e & ~at(i + 1), i)), lambda i: i.isNotNull())
    bounds = flags.select("doc_id", "toks", F.posexplode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("nr", "s"))
    entity = F.array_join(F.slice("toks", F.col("s.b") + 1, F.col("s.e") - F.col("s.b") + 1), " ")
    return bounds.select("doc_id", (F.col("nr") + 1).cast("bigint").alias("span_no"), F.col("s.b").cast("bigint").alias("begin_pos"), entity.alias("entity"))


@query(
    "q30_context_prediction",
    f"""
    with d as (select doc_id, {sql_tokens('text')} as toks from documents),
    l as (select *, unnest([25, 50]) as layer, len(toks) as n from d),
    p as (select *, 1 + {int32("doc_id || '#' || layer", 'k_t')} % 20 as k_t, 1 + {int32("doc_id || '#' || layer", 'k_a')} % 10 as k_a, {int32("doc_id || '#' || layer", 'dir')} % 2 = 0 as past from l),
    k as (select *, case when past then k_t + {int32("doc_id || '#' || layer", 'begin')} % greatest(n - k_a - 1 - k_t + 1, 1) else 1 + {int32("doc_id || '#' || layer", 'begin')} % greatest(n - k_a - k_t, 1) end as b from p where n >= k_t + k_a + 1)
    select doc_id, layer, case when past then 'past' else 'future' end as direction, k_t as k_tokens, k_a as k_acts, b as begin_pos, b + k_a as context_len,
      array_to_string(case when past then toks[b - k_t + 1 : b] else toks[b + k_a + 1 : b + k_a + k_t] end, ' ') as target from k""",
)
def context_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Predict the tokens before or after a window: drawn sizes and places, with the guard on short texts; the context ends at the window's end."""
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("toks")).withColumn("layer", F.explode(F.array(F.lit(25), F.lit(50)))).withColumn("n", F.size("toks"))
    k = F.concat_ws("#", "doc_id", "layer")
    drawn = docs.withColumn("k_tokens", 1 + md5_int(k, "k_t") % 20).withColumn("k_acts", 1 + md5_int(k, "k_a") % 10).withColumn("past", md5_int(k, "dir") % 2 == 0).where("n >= k_tokens + k_acts + 1")
    r = md5_int(k, "begin")
    begin = F.when(F.col("past"), F.col("k_tokens") + r % F.greatest(F.col("n") - F.col("k_acts") - F.col("k_tokens"), F.lit(1))).otherwise(1 + r % F.greatest(F.col("n") - F.col("k_acts") - F.col("k_tokens"), F.lit(1)))
    placed = drawn.withColumn("b", begin.cast("int"))
    end = F.col("b") + F.col("k_acts").cast("int")
    target = F.when(F.col("past"), seq.py_slice(F.col("toks"), F.col("b") - F.col("k_tokens").cast("int"), F.col("b"))).otherwise(seq.py_slice(F.col("toks"), end, end + F.col("k_tokens").cast("int")))
    return placed.select("doc_id", "layer", F.when(F.col("past"), "past").otherwise("future").alias("direction"), "k_tokens", "k_acts", F.col("b").cast("bigint").alias("begin_pos"), end.cast("bigint").alias("context_len"), F.array_join(target, " ").alias("target"))


@query(
    "q33_chat_render",
    f"""
    with {TURNS}
    select point_id, string_agg('<|' || coalesce(role, '') || '|>' || coalesce(content, ''), chr(10) order by pos) as rendered,
      string_agg('<|' || coalesce(role, '') || '|>' || coalesce(content, ''), chr(10) order by pos) || chr(10) || '<|assistant|>' as with_prompt from turns group by point_id""",
)
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return dialogs(spark, d).select("point_id", seq.render_chat(F.col("dialog")).alias("rendered"), seq.render_chat(F.col("dialog"), generation_prompt=True).alias("with_prompt"))


@query(
    "q34_incremental_turns",
    f"""
    with {TURNS}, t as (select *, row_number() over (partition by point_id order by pos) - 1 as k, count(*) over (partition by point_id) as n from turns where role <> 'system'),
    p as (select a.point_id, a.k // 2 as pair from t a where a.role = 'assistant' and a.k % 2 = 1)
    select p.point_id, p.pair + 1 as n_turns, string_agg(t.role || ': ' || coalesce(t.content, ''), chr(10) order by t.k) as messages
    from p join t on t.point_id = p.point_id and t.k <= 2 * p.pair + 1 group by 1, 2""",
)
def incremental_turns(spark: SparkSession, d: str) -> DataFrame:
    """The conversation up to each answer: turns paired among those that aren't the system's, an odd tail dropped."""
    rows = dialogs(spark, d).select("point_id", seq.without_system(F.col("dialog")).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(F.size("t") / 2).cast("int"), F.lit(1))), lambda k: F.try_element_at("t", 2 * k)["role"] == "assistant")
    grown = rows.withColumn("n_turns", F.explode(ends))
    said = F.transform(F.slice("t", 1, F.col("n_turns") * 2), lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["content"], F.lit(""))))
    return grown.select("point_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.array_join(said, "\n").alias("messages"))


@query(
    "q35_first_exchange_capped",
    f"""
    with {TURNS}, t as (select *, row_number() over (partition by point_id order by pos) as k from turns),
    x as (select point_id, string_agg(coalesce(content, ''), chr(10) order by k) as exchange, sum(length(coalesce(content, ''))) as chars from t where k <= 2 group by point_id),
    r as (select *, row_number() over (order by point_id) as ord from x where chars <= 260)
    select point_id, exchange, cast(chars as bigint) as chars, (select count(*) from x) as seen, (select count(*) from x where chars <= 260) as fitting from r where ord <= 100""",
)
def first_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The first two turns if short enough; the first 100 by id, with how many were seen and how many fit."""
    two = dialogs(spark, d).select("point_id", F.slice("dialog", 1, 2).alias("t"))
    said = F.transform("t", lambda x: F.coalesce(x["content"], F.lit("")))
    rows = two.select("point_id", F.array_join(said, "\n").alias("exchange"), F.aggregate(said, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))
    counts = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("chars") <= 260).alias("fitting"))
    return rows.where("chars <= 260").orderBy("point_id").limit(100).crossJoin(F.broadcast(counts))


@query(
    "q36_assistant_mask",
    f"""
    with {TURNS}, t as (select *, len({sql_tokens('content')}) as n from turns)
    select point_id, string_agg(repeat('0', 1) || repeat(case when role = 'assistant' then '1' else '0' end, cast(n as int)) || case when role = 'assistant' then '1' else '0' end, '' order by pos) as mask,
      cast(sum(case when role = 'assistant' then n + 1 else 0 end) as bigint) as n_loss from t group by point_id""",
)
def assistant_mask(spark: SparkSession, d: str) -> DataFrame:
    """Loss mask from turns: the header of a turn carries none, an assistant's words and its end mark do."""
    one = lambda t: F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
    part = lambda t: F.concat(F.lit("0"), F.repeat(one(t), F.size(tokens(t["content"]))), one(t))
    mask = F.array_join(F.transform("dialog", part), "")
    return dialogs(spark, d).select("point_id", mask.alias("mask")).withColumn("n_loss", F.length(F.replace("mask", F.lit("0"), F.lit(""))).cast("bigint"))


@query(
    "q37_loss_labels_padding",
    """
    with p as (select point_id, any_value(input_ids) as ids, any_value(labels) as labels, any_value(positions) as pos from training_datapoints group by point_id),
    n as (select *, len(list_filter(labels, lambda x: x = -100)) as n_masked, point_id // 16 as batch from p where ids is not null),
    m as (select *, max(len(ids)) over (partition by batch) as padded from n)
    select point_id, batch, padded, padded - len(ids) as n_pad, n_masked, array_to_string(list_transform(pos, lambda x: x + padded - len(ids)), ',') as shifted from m""",
)
def loss_padding(spark: SparkSession, d: str) -> DataFrame:
    """Left padding to the longest row of each batch of 16, with positions moved along; padding and unpadding are inverse.

    Rows are exchanged once, by batch: duplicates of a record and the longest row of a batch are found where the batch lies.
    """
    points = table(spark, d, "training_datapoints").where("input_ids is not null").select("point_id", F.floor(F.col("point_id") / 16).alias("batch"), "input_ids", "labels", "positions")
    once = points.repartition("batch").dropDuplicates(["batch", "point_id"])
    padded = once.withColumn("padded", F.max(F.size("input_ids")).over(Window.partitionBy("batch")))
    ids, mask = seq.left_pad(F.col("input_ids"), F.col("padded")), seq.pad_mask(F.col("input_ids"), F.col("padded"))
    checked = padded.where(seq.unpad(ids, mask) == F.col("input_ids"))
    return checked.select(
        "point_id", "batch", F.col("padded").cast("bigint").alias("padded"), (F.col("padded") - F.size("input_ids")).cast("bigint").alias("n_pad"),
        F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"),
        F.array_join(seq.shifted(F.col("positions"), F.col("padded") - F.size("input_ids")).cast("array<string>"), ",").alias("shifted"),
    )


@query(
    "q38_marker_positions",
    f"""
    with d as (select doc_id, list_concat(['Layer:', '50'], list_transform(range(0, 1 + {below('doc_id', 'marks', '5')}), lambda x: '?'), {sql_tokens('text')}) as toks from documents),
    p as (select doc_id, toks, list_filter(range(0, len(toks)), lambda i: toks[i + 1] = '?')[1:3] as pos from d)
    select doc_id, array_to_string(pos, ',') as positions, len(pos) as n_found, case when len(pos) = 0 then false else pos[-1] - pos[1] = len(pos) - 1 end as consecutive from p""",
)
def marker_positions(spark: SparkSession, d: str) -> DataFrame:
    """A prefix with a drawn number of markers; the first three are found and must follow each other."""
    marks = F.transform(F.sequence(F.lit(1), (1 + md5_below("doc_id", "marks", 5)).cast("int")), lambda i: F.lit("?"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.array(F.lit("Layer:"), F.lit("50")), marks, tokens(F.col("text"))).alias("toks"))
    found = docs.select("doc_id", seq.marker_positions(F.col("toks"), "?", 3).alias("p"))
    return found.select("doc_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"), F.size("p").cast("bigint").alias("n_found"), seq.is_run(F.col("p")).alias("consecutive"))


@query(
    "q39_end_window",
    f"""
    with d as (select doc_id, len({sql_tokens('text')}) as n, -1 - {below('doc_id', 'offset', '5')} as off, 1 + {below('doc_id', 'k', '10')} as k from documents),
    e as (select *, n + off as e, least(k, n + off + 1) as kept from d)
    select doc_id, cast(off as bigint) as off, case when kept > 0 then e - kept + 1 end as begin_pos, case when kept > 0 then e end as end_pos, cast(greatest(kept, 0) as bigint) as n_kept,
      greatest(1, least(e, n - 1)) as clamped, case when kept > 0 then e else n - 1 end as or_last from e""",
)
def end_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows anchored at the end, cut to the text, with the clamp and the fall-back to the last place."""
    docs = table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n"), (-1 - md5_below("doc_id", "offset", 5)).cast("int").alias("off"), (1 + md5_below("doc_id", "k", 10)).cast("int").alias("k"))
    end = F.col("n") + F.col("off")
    kept = F.least(F.col("k"), end + 1)
    w = docs.withColumn("w", F.when(kept > 0, F.sequence(end - kept + 1, end)).otherwise(F.array().cast("array<int>")))
    big = lambda c: c.cast("bigint")
    return w.select(
        "doc_id", big(F.col("off")).alias("off"), big(F.try_element_at("w", F.lit(1))).alias("begin_pos"), big(F.try_element_at("w", F.lit(-1))).alias("end_pos"), big(F.size("w")).alias("n_kept"),
        big(seq.clamp_end(end, F.col("n"))).alias("clamped"), big(F.coalesce(F.try_element_at("w", F.lit(-1)), F.col("n") - 1)).alias("or_last"),
    )


SEGMENT_REPEATS, FULL_REPEATS = 2, 3


@query(
    "q40_probe_fanout",
    f"""
    with r as (select distinct result_id, num_tokens from verbalizer_results where num_tokens is not null)
    select result_id, 'token' as kind, unnest(range(0, num_tokens)) as index from r
    union all select result_id, 'segment', unnest(range(0, {SEGMENT_REPEATS})) from r
    union all select result_id, 'full', unnest(range(0, {FULL_REPEATS})) from r""",
)
def probe_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One row for each token, and repeated rows for the segment and the full sequence."""
    rows = table(spark, d, "verbalizer_results").where("num_tokens is not null").select("result_id", "num_tokens").distinct()
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    kinds = {"token": F.col("num_tokens"), "segment": F.lit(SEGMENT_REPEATS), "full": F.lit(FULL_REPEATS)}
    return joins.union_all(*[rows.select("result_id", F.lit(kind).alias("kind"), F.explode(upto(n.cast("bigint"))).alias("index")) for kind, n in kinds.items()])


@query(
    "q41_regroup_responses",
    f"""
    with r as (select distinct result_id, num_tokens from verbalizer_results where num_tokens > 0),
    p as (select result_id, num_tokens, unnest(range(0, num_tokens)) as i from r),
    a as (select *, 'r' || {below("result_id || '#' || i", 'respond', '100')} as response from p where {below("result_id || '#' || i", 'drop', '4')} <> 0)
    select r.result_id, array_to_string(list_transform(range(0, r.num_tokens), lambda i: coalesce(g.m[i][1], '-')), ' ') as dense, cast(r.num_tokens - coalesce(g.n, 0) as bigint) as n_null
    from r left join (select result_id, map(list(i), list([response])) as m, count(*) as n from a group by result_id) g on g.result_id = r.result_id""",
)
def regroup_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses that arrive singly, some not at all, put back into dense slots with nulls."""
    rows = table(spark, d, "verbalizer_results").where("num_tokens > 0").select("result_id", "num_tokens").distinct()
    k = F.concat_ws("#", "result_id", "i")
    asked = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("num_tokens") - 1)))
    answered = asked.where(md5_below(k, "drop", 4) != 0).select("result_id", "num_tokens", F.struct(F.col("i").alias("index"), F.concat(F.lit("r"), md5_below(k, "respond", 100)).alias("value")).alias("s"))
    gathered = rows.join(answered.groupBy("result_id").agg(F.collect_list("s").alias("slots")), "result_id", "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<struct<index:int,value:string>>")))
    full = gathered.withColumn("dense", seq.dense(F.col("slots"), F.col("num_tokens")))
    return full.select("result_id", F.array_join(F.transform("dense", lambda x: F.coalesce(x, F.lit("-"))), " ").alias("dense"), F.size(F.filter("dense", lambda x: x.isNull())).cast("bigint").alias("n_null"))


@query(
    "q42_latent_qa",
    """
    with p as (select point_id, any_value(label) as label, any_value(source) as source, any_value(read_prompt) as rp, any_value(dialog) as dialog from latentqa_datapoints where len(dialog) > 0 group by point_id),
    s as (select *, row_number() over (partition by label order by point_id) - 1 as behaviour, count(*) over (partition by label) as n_behaviours from p where label is not null and source is not null),
    q as (select unnest(['goal', 'tone', 'origin']) as ask, unnest([0, 1, 2]) as qa)
    select point_id, label, source, qa * n_behaviours + behaviour as pair_id, ask,
      case source when 'system' then 2 when 'control' then 2 when 'stimulus_completion' then 2 else 0 end as n_masked,
      coalesce(list_filter(dialog, lambda t: t.role = 'system')[1].content, list_filter(dialog, lambda t: t.role = 'user')[1].content) as instruction,
      case source when 'system' then 'system' when 'control' then 'system' else 'user' end as mask_type,
      array_to_string(list_transform(rp[1 : case source when 'system' then 2 when 'control' then 2 when 'stimulus_completion' then 2 else 0 end], lambda t: coalesce(t.role, '')), ',') as masked_roles
    from s, q""",
)
def latent_qa(spark: SparkSession, d: str) -> DataFrame:
    """Behaviours of a label by the fixed questions on it; the pair's id is decoded from (question, behaviour), and leading turns are masked by source."""
    rows = dialogs(spark, d).where("label is not null and source is not null")
    from weftline.ranks import value_rank

    ranked = value_rank(rows, "point_id", "point_id", ["label"], rank="_r").join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_behaviours")), "label")
    asks = F.array(*[F.struct(F.lit(i).alias("qa"), F.lit(a).alias("ask")) for i, a in enumerate(("goal", "tone", "origin"))])
    out = ranked.withColumn("q", F.explode(asks))
    masked = F.when(F.col("source").isin("system", "control", "stimulus_completion"), 2).otherwise(0)
    return out.select(
        "point_id", "label", "source", (F.col("q.qa") * F.col("n_behaviours") + F.col("_r") - 1).alias("pair_id"), F.col("q.ask").alias("ask"), masked.alias("n_masked"),
        seq.hidden_instruction(F.col("dialog")).alias("instruction"), F.when(F.col("source").isin("system", "control"), "system").otherwise("user").alias("mask_type"),
        F.array_join(F.transform(F.slice("read_prompt", F.lit(1), masked), lambda t: F.coalesce(t["role"], F.lit(""))), ",").alias("masked_roles"),
    )


@query(
    "q43_modulo_overlay",
    """
    with a as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents),
    b as (select config_id, row_number() over (order by config_id) - 1 as j, count(*) over () as n from dataset_loader_configs)
    select doc_id, config_id from a join b on a.i % b.n = b.j""",
)
def modulo_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Row i with overlay i mod n."""
    return joins.round_robin(table(spark, d, "documents").select("doc_id"), table(spark, d, "dataset_loader_configs").select("config_id"), "doc_id", "config_id").select("doc_id", "config_id")


@query(
    "q44_negative_slices",
    """
    select distinct result_id, array_to_string(list_transform(case when len(r) >= 3 then r[len(r) - 2 : len(r) - 2] else [] end, lambda x: coalesce(x, '-')), '|') as third_last,
      array_to_string(list_transform(r[greatest(len(r) - 1, 1) : len(r)], lambda x: coalesce(x, '-')), '|') as last_two from (select result_id, coalesce(token_responses, []) as r from verbalizer_results)""",
)
def negative_slices(spark: SparkSession, d: str) -> DataFrame:
    """``[-3:-2]`` and ``[-2:]``; places beyond the start give nothing."""
    rows = table(spark, d, "verbalizer_results").select("result_id", F.coalesce("token_responses", F.array().cast("array<string>")).alias("r")).distinct()
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("-"))), "|")
    third = F.when(F.size("r") >= 3, seq.py_slice(F.col("r"), -3, -2)).otherwise(F.array().cast("array<string>"))
    last = F.slice("r", F.greatest(F.size("r") - 1, F.lit(1)), F.lit(2))
    return rows.select("result_id", shown(third).alias("third_last"), shown(last).alias("last_two"))


@query(
    "q45_point_invariants",
    """
    with p as (select point_id, any_value(input_ids) as ids, any_value(labels) as l, any_value(positions) as pos, any_value(context_input_ids) as cids, any_value(context_positions) as cpos from training_datapoints group by point_id)
    select case when len(ids) <> len(l) then 'labels_length' when cids is null and cpos is not null or cids is not null and cpos is null then 'context_half' when cpos is not null and len(cpos) <> len(pos) then 'positions_length' else 'none' end as violation, count(*) as n from p where ids is not null group by 1""",
)
def point_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The record's cross-field contract as a quality report instead of an exception."""
    p = table(spark, d, "training_datapoints").where("input_ids is not null").dropDuplicates(["point_id"])
    half = F.col("context_input_ids").isNull() != F.col("context_positions").isNull()
    bad = F.when(F.size("input_ids") != F.size("labels"), "labels_length").when(half, "context_half").when(F.col("context_positions").isNotNull() & (F.size("context_positions") != F.size("positions")), "positions_length")
    return p.groupBy(F.coalesce(bad, F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q46_prompt_only",
    """
    with p as (select point_id, any_value(input_ids) as ids, any_value(labels) as l from training_datapoints group by point_id)
    select point_id, len(list_filter(range(1, len(ids) + 1), lambda i: l[i] = -100)) as n_prompt, coalesce(list_position(list_transform(l, lambda x: x <> -100), true), len(l) + 1) - 1 as first_loss,
      coalesce(list_sum(list_filter(range(1, len(ids) + 1), lambda i: l[i] = -100).list_transform(lambda i: ids[i])), 0) as id_sum
    from p where len(ids) = len(l)""",
)
def prompt_only(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the response is cut off."""
    p = table(spark, d, "training_datapoints").where("size(input_ids) = size(labels)").dropDuplicates(["point_id"])
    cut = p.withColumn("prompt", seq.prompt_part(F.col("input_ids"), F.col("labels")))
    first = F.array_position(F.transform("labels", lambda x: x != -100), True)
    total: Column = F.aggregate("prompt", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return cut.select("point_id", F.size("prompt").cast("bigint").alias("n_prompt"), F.when(first > 0, first - 1).otherwise(F.size("labels")).alias("first_loss"), total.alias("id_sum"))


@query(
    "q47_layer_gather",
    f"""
    with r as (select config_id, layer_percents from dataset_loader_configs where layer_percents is not null),
    e as (select config_id, unnest(range(1, len(layer_percents) + 1)) as i, layer_percents from r),
    l as (select config_id, i - 1 as ord, layer_percents[i] as pct, cast(floor(36 * layer_percents[i] / 100) as bigint) as layer from e)
    select config_id, array_to_string(list(layer order by ord), ',') as layers, count(distinct layer) as n_distinct, array_to_string(flatten(list([layer * 10, layer * 10 + 1] order by ord)), ',') as positions from l group by config_id""",
)
def layer_gather(spark: SparkSession, d: str) -> DataFrame:
    """Percentages to layers by truncation; layers read once each and put together in the order asked for."""
    rows = table(spark, d, "dataset_loader_configs").where("layer_percents is not null").select("config_id", F.transform("layer_percents", lambda p: F.floor(36 * p / 100)).alias("l"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    blocks = F.flatten(F.transform("l", lambda x: F.array(x * 10, x * 10 + 1)))
    return rows.where("size(l) > 0").select("config_id", text(F.col("l")).alias("layers"), F.size(F.array_distinct("l")).cast("bigint").alias("n_distinct"), text(blocks).alias("positions"))


@query(
    "q48_split_by_role",
    f"""
    with {TURNS}
    select point_id, count(*) filter (where role = 'system') as n_system, count(*) filter (where role <> 'system') as n_rest, count(*) filter (where role = 'system') > 1 as is_error from turns group by point_id""",
)
def split_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Turns parted by a predicate; more than one system turn is an error."""
    n = F.size(F.filter("dialog", lambda t: t["role"] == "system"))
    return dialogs(spark, d).select("point_id", n.cast("bigint").alias("n_system"), F.size(F.filter("dialog", lambda t: t["role"] != "system")).cast("bigint").alias("n_rest"), (n > 1).alias("is_error"))
