"""Features and their examples, probes, image questions, masks and providers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as seq
from weftline.functions import text, vectors
from weftline.operators import cache, joins, probes, sampling
from weftline.operators.neighbours import cosine_top_k
from weftline.plans.dialect import below, key, tokens as sql_tokens
from weftline.plans.registry import query
from weftline.plans.statements import YES_NO, _sql_list
from weftline.plans.vectors import _DOT, _NORM, _V, embeddings
from weftline.rand import md5_below
from weftline.sources.readers import image_paths
from weftline.storage import table

LEFT_OUT = ["terse", "humble", "calm"]


@query(
    "q111_label_prefixes",
    f"""
    with p as (select distinct point_id, label from latentqa_datapoints)
    select point_id, label, split_part(coalesce(label, ''), '_', 1) as prefix from p where split_part(coalesce(label, ''), '_', 1) not in ({', '.join(f"'{x}'" for x in LEFT_OUT)})""",
)
def label_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Records whose label's first part isn't in a list of exclusions; a null label has an empty first part and stays."""
    p = table(spark, d, "latentqa_datapoints").select("point_id", "label").distinct()
    prefixed = p.withColumn("prefix", seq.label_prefix(F.col("label"), "_"))
    return prefixed.where(~F.col("prefix").isin(LEFT_OUT))


#: Ids that begin, end and pad a sequence.
BEGIN, END, PAD = 1, 2, 0


@query(
    "q112_special_tokens",
    f"""
    with p as (select point_id, any_value(input_ids) as ids from training_datapoints group by point_id),
    k as (select point_id, ids, list_filter(ids, lambda x: x not in ({BEGIN}, {END}, {PAD})) as kept from p where ids is not null)
    select point_id, len(ids) - len(kept) as n_special, len(kept) as n_kept, kept[1] as first_kept, list_position(kept, 13) - 1 as marker_at, cast(list_sum(list_transform(range(1, len(kept) + 1), lambda i: i * kept[i])) as bigint) as checksum from k""",
)
def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Special ids are masked and taken out before places are counted, so a marker's place is among the real ids."""
    p = table(spark, d, "training_datapoints").where("input_ids is not null").groupBy("point_id").agg(F.first("input_ids").alias("ids"))
    kept = p.select("point_id", F.size(F.filter(seq.special_mask(F.col("ids"), BEGIN, END, PAD), lambda m: m)).cast("bigint").alias("n_special"), seq.without_special(F.col("ids"), BEGIN, END, PAD).alias("kept"))
    total = F.aggregate(F.transform("kept", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    marker = F.array_position("kept", F.lit(13))
    return kept.select("point_id", "n_special", F.size("kept").cast("bigint").alias("n_kept"), F.get("kept", F.lit(0)).alias("first_kept"), F.when(marker > 0, marker - 1).alias("marker_at"), F.when(F.size("kept") > 0, total).alias("checksum"))


MOST_EXAMPLES = 5
TEMPLATES = ["Write {k} texts on which this feature is active.", "Show {k} examples that activate the feature.", "Give {k} passages in which it fires."]


@query(
    "q113_activating_examples",
    f"""
    with {_V}, a as (select label, vec_id, round(list_sum(v), 9) as act from e where label is not null),
    r as (select *, row_number() over (partition by label order by act desc, vec_id) as rank from a),
    k as (select *, 2 + {below('label', 'examples', str(MOST_EXAMPLES - 1))} as k from r where rank <= {MOST_EXAMPLES}),
    g as (select label, any_value(k) as k, list(vec_id order by rank) as ids, list(act order by rank) as acts from k where rank <= k group by label)
    select label, k, replace({_sql_list(TEMPLATES)}[1 + {below('label', 'template', str(len(TEMPLATES)))}], '{{k}}', cast(k as varchar)) as prompt,
      array_to_string(list_transform(range(1, len(ids) + 1), lambda i: 'Example ' || i || ': vector ' || ids[i]), chr(10)) as target from g where len(ids) = k and acts[k] > 0""",
)
def activating_examples(spark: SparkSession, d: str) -> DataFrame:
    """A feature's strongest examples as a numbered list under a drawn template; features whose last example isn't active are dropped.

    Only MOST_EXAMPLES rows of a feature leave a partition, so a feature with a third of the rows is no burden.
    """
    a = embeddings(spark, d).where("label is not null").select("label", "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 9).alias("act"))
    strongest = a.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("act"), "vec_id"))).where(F.col("rank") <= MOST_EXAMPLES)
    drawn = strongest.withColumn("k", 2 + md5_below("label", "examples", MOST_EXAMPLES - 1)).where("rank <= k")
    g = drawn.groupBy("label", "k").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "act"))).alias("x")).where((F.size("x") == F.col("k")) & (F.element_at("x", -1)["act"] > 0))
    template = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), md5_below("label", "template", len(TEMPLATES)).cast("int"))
    target = text.numbered(F.transform("x", lambda x: F.concat(F.lit("vector "), x["vec_id"])))
    return g.select("label", "k", F.replace(template, F.lit("{k}"), F.col("k").cast("string")).alias("prompt"), target.alias("target"))


@query(
    "q114_aligned_keys",
    """
    with a as (select result_id as k, row_number() over (order by result_id) as at from (select distinct result_id from verbalizer_results)),
    b as (select point_id as k, row_number() over (order by point_id) as at from (select distinct point_id from latentqa_datapoints))
    select count(a.at) as n_left, count(b.at) as n_right, count(*) filter (where a.at is not null and b.at is not null) as n_met, count(*) filter (where a.at is not null and b.at is not null and a.k <> b.k) as n_other from a full join b on a.at = b.at""",
)
def aligned_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two lists zipped by place, and at how many places their keys differ."""
    a = table(spark, d, "verbalizer_results").select(F.col("result_id").alias("k")).distinct()
    b = table(spark, d, "latentqa_datapoints").select(F.col("point_id").alias("k")).distinct()
    return joins.aligned(a, b, "k", "k", "k")


@query(
    "q115_ragged_context",
    """
    with p as (select point_id, any_value(context_input_ids) as ids, any_value(context_positions) as pos from training_datapoints where context_input_ids is not null and context_positions is not null group by point_id),
    m as (select *, point_id // 16 as batch, max(len(ids)) over (partition by point_id // 16) as padded from p)
    select point_id, batch, padded, padded - len(ids) as left_offset, array_to_string(list_transform(pos, lambda x: x + padded - len(ids)), ',') as shifted,
      len(list_filter(pos, lambda x: x + padded - len(ids) < 0 or x + padded - len(ids) >= padded)) as n_outside from m""",
)
def ragged_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts padded on the left to the longest of their batch, their positions moved by each row's own offset and held against the range; one exchange, by batch."""
    points = table(spark, d, "training_datapoints").where("context_input_ids is not null and context_positions is not null").select("point_id", F.floor(F.col("point_id") / 16).alias("batch"), F.size("context_input_ids").alias("n"), "context_positions")
    once = points.repartition("batch").dropDuplicates(["batch", "point_id"])
    padded = once.withColumn("padded", F.max("n").over(Window.partitionBy("batch"))).withColumn("left_offset", F.col("padded") - F.col("n"))
    moved = padded.withColumn("s", seq.shifted(F.col("context_positions"), F.col("left_offset")))
    outside = F.size(F.filter("s", lambda x: (x < 0) | (x >= F.col("padded"))))
    return moved.select("point_id", "batch", F.col("padded").cast("bigint").alias("padded"), F.col("left_offset").cast("bigint").alias("left_offset"), F.array_join(F.col("s").cast("array<string>"), ",").alias("shifted"), outside.cast("bigint").alias("n_outside"))


SIMILAR, LIMIT = 10, 0.05


@query(
    "q116_inactive_neighbours",
    f"""
    with {_V}, n as (select vec_id, v, {_NORM.format('v')} as n from e),
    s as (select a.vec_id, b.vec_id as neighbour, {_DOT.format('a.v', 'b.v')} / (a.n * b.n) as sim from n a, n b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by vec_id order by sim desc, neighbour) as rank from s),
    x as (select vec_id, neighbour, rank, neighbour + step as example from r, (select unnest([0, 1]) as step) where rank <= {SIMILAR}),
    a as (select x.*, greatest(0.0, {_DOT.format('t.v[1:32]', 'e.v[1:32]')}) as first_act, greatest(0.0, {_DOT.format('t.v[33:64]', 'e.v[33:64]')}) as second_act, greatest({_DOT.format('t.v[1:32]', 't.v[1:32]')}, {_DOT.format('t.v[33:64]', 't.v[33:64]')}) as own
      from x join e t on t.vec_id = x.vec_id join e on e.vec_id = x.example)
    select vec_id, neighbour, rank, example, round(greatest(first_act, second_act), 6) as max_act, round({LIMIT} * own, 6) as most from a where round(greatest(first_act, second_act), 9) <= round({LIMIT} * own, 9)""",
)
def inactive_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives: examples of a feature's nearest features on which the feature itself hardly fires.

    A feature is a row, its examples are that row and the next, an example has two positions (the halves of its vector). Examples stay whose greatest
    activation under the target is at most LIMIT of the target's greatest on its own. Targets are the rows whose id is divisible by 100, against all rows.
    """
    rows, e = table(spark, d, "embeddings"), embeddings(spark, d).select("vec_id", "v")
    near = cosine_top_k(rows.where("vec_id % 100 = 0"), rows, SIMILAR).drop("similarity")
    x = near.withColumn("example", F.explode(F.array(F.col("neighbour"), F.col("neighbour") + 1)))
    joined = x.join(e.withColumnRenamed("v", "t"), "vec_id").join(e.select(F.col("vec_id").alias("example"), F.col("v").alias("x")), "example")
    half = lambda a, b, at: vectors.dot(F.slice(a, at, 32), F.slice(b, at, 32))
    act = F.greatest(F.lit(0.0), half("t", "x", 1), half("t", "x", 33))
    most = LIMIT * F.greatest(half("t", "t", 1), half("t", "t", 33))
    return joined.withColumns({"_a": act, "_m": most}).where(F.round("_a", 9) <= F.round("_m", 9)).select("vec_id", "neighbour", "rank", "example", F.round("_a", 6).alias("max_act"), F.round("_m", 6).alias("most"))


@query("q117_softmax_probe")
def softmax_probe(spark: SparkSession, d: str) -> DataFrame:
    """A linear softmax probe of the labels' last digit, fitted on four fifths of the vectors: rows and accuracy of both parts. Iterative, so tested against a fit in numpy."""
    rows = embeddings(spark, d).select("vec_id", (F.col("label") % 10).alias("label"), F.col("v").alias("vector"), (F.col("vec_id") % 5 != 0).alias("is_train"))
    probed = probes.softmax_probe(rows, "vector", "label", "is_train")
    return probed.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("label_index")).cast("double")), 6).alias("accuracy"))


ENTAILS = {"entailment": "Yes", "contradiction": "No"}
LAYERS = [25, 50, 75]
IMAGE_PARAPHRASES = ["Does the picture show this?", "Is this true of the image?", "Would the image bear this out?", "Can this be seen?"]


@query(
    "q118_image_entailment",
    f"""
    with s as (select distinct sample_id, lower(trim(ds_label, ' ')) as label, context from context_qa_samples where context is not null and trim(context, ' ') <> ''),
    files as (select 'img_' || p_partkey || case p_partkey % 3 when 1 then '.jpg' else '.png' end as name from part where p_partkey % 3 <> 0),
    c as (select *, case label when 'entailment' then 'Yes' when 'contradiction' then 'No' end as answer, 'img_' || (sample_id % 150) as image from s),
    i as (select c.*, case when exists (select 1 from files where name = image || '.jpg') then image || '.jpg' when exists (select 1 from files where name = image || '.png') then image || '.png' end as path from c where answer is not null),
    p as (select i.*, q.p, row_number() over (partition by sample_id order by {key("sample_id || '#' || p", 'entail')}) as rn from i, (select unnest({_sql_list(IMAGE_PARAPHRASES)}) as p) q where path is not null),
    w as (select *, unnest({LAYERS}) as layer, len({sql_tokens('context')}) as n from p where rn <= 2),
    o as (select *, greatest(1, least(n - 1 - {below("sample_id || '#' || p", 'offset', '5')}, case when n > 1 then n - 1 else 0 end)) as stop, 1 + {below("sample_id || '#' || p", 'window', '10')} as size from w)
    select sample_id, layer, path, answer, md5('Answer with ''Yes'' or ''No'' only. # ' || p || ' ' || context) as question, stop - greatest(least(size, stop + 1), 1) + 1 as begin_pos, stop as end_pos, 1 as n_images from o""",
)
def image_entailment(spark: SparkSession, d: str) -> DataFrame:
    """Labels to answers (neutral ones dropped), images by the first name that exists, paraphrases, layers, windows of positions and messages with an image part."""
    s = table(spark, d, "context_qa_samples").select("sample_id", F.lower(F.trim("ds_label")).alias("label"), "context").where("context is not null and trim(context) <> ''").distinct()
    answers = F.create_map(*[F.lit(x) for pair in ENTAILS.items() for x in pair])
    known = s.withColumn("answer", F.try_element_at(answers, F.col("label"))).where("answer is not null").withColumn("image", F.concat(F.lit("img_"), F.col("sample_id") % 150)).drop("label")
    files = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("img_"), "p_partkey", F.when(F.col("p_partkey") % 3 == 1, ".jpg").otherwise(".png")).alias("path"))
    found = joins.first_candidate(known, [F.concat("image", F.lit(".jpg")), F.concat("image", F.lit(".png"))], files, "path")
    asked = found.withColumn("p", F.explode(sampling.some_of(F.array(*[F.lit(p) for p in IMAGE_PARAPHRASES]), 2, "sample_id", "entail"))).withColumn("layer", F.explode(F.array(*map(F.lit, LAYERS))))
    k, n = F.concat_ws("#", "sample_id", "p"), F.size(text.tokens(F.col("context")))
    window = seq.image_window(n, -1 - md5_below(k, "offset", 5), 1 + md5_below(k, "window", 10))
    part = lambda kind, words, image: F.struct(F.lit(kind).alias("type"), words.cast("string").alias("text"), image.cast("string").alias("image"), F.lit(None).cast("string").alias("path"))
    content = F.array(part("image", F.lit(None), F.col("path")), part("text", F.col("context"), F.lit(None)))
    question = F.concat(F.lit(f"{YES_NO} # "), "p", F.lit(" "), "context")
    return asked.withColumn("w", window).select("sample_id", "layer", "path", "answer", F.md5(question).alias("question"), F.col("w.begin").cast("bigint").alias("begin_pos"), F.col("w.end").cast("bigint").alias("end_pos"), F.size(image_paths(content)).alias("n_images"))


@query(
    "q124_single_prompt",
    """
    with r as (select distinct result_id, num_tokens, len(context_input_ids) as n from verbalizer_results where context_input_ids is not null),
    s as (select *, -(1 + result_id % 12) as a0, case when result_id % 4 = 0 then 10 else n end as b0 from r),
    x as (select *, case when a0 < 0 then a0 + n else a0 end as a, b0 as b from s)
    select result_id, n as n_tokens, a as start_pos, b as end_pos, a >= 0 and a < b and b <= n as valid, case when a >= 0 and a < b and b <= n then b - a + 2 else 0 end as n_probes from x""",
)
def single_prompt(spark: SparkSession, d: str) -> DataFrame:
    """One prompt asked about itself: a range of positions, negative ones from the end, checked against its length; a probe for each position, one for the range and one for all."""
    r = table(spark, d, "verbalizer_results").where("context_input_ids is not null").select("result_id", "num_tokens", F.size("context_input_ids").cast("bigint").alias("n")).distinct()
    span = seq.absolute_range(-(1 + F.col("result_id") % 12), F.when(F.col("result_id") % 4 == 0, F.lit(10)).otherwise(F.col("n")), F.col("n"))
    x = r.withColumn("s", span)
    return x.select("result_id", F.col("n").alias("n_tokens"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.valid").alias("valid"), F.when(F.col("s.valid"), F.col("s.end") - F.col("s.start") + 2).otherwise(0).alias("n_probes"))


def _stand_in(prompts: pd.Series) -> pd.Series:
    """A provider in a model's place: the number of characters of the prompt."""
    return prompts.fillna("").str.len().astype(str)


@query(
    "q125_ordered_responses",
    """
    with r as (select distinct result_id, verbalizer_prompt from verbalizer_results)
    select result_id, row_number() over (order by result_id) - 1 as ordinal, cast(length(coalesce(verbalizer_prompt, '')) as varchar) as response from r""",
)
def ordered_responses(spark: SparkSession, d: str) -> DataFrame:
    """Prompts answered by a provider on four partitions, each with the place of its request."""
    r = table(spark, d, "verbalizer_results").select("result_id", "verbalizer_prompt").distinct()
    return cache.respond_in_order(r, "verbalizer_prompt", "result_id", _stand_in, parallel=4).select("result_id", "ordinal", "response")


GOALS, TOPICS, TRIES, NEEDED = ["hide a word", "name a place", "keep a secret"], ["food", "music", "work", "travel"], 3, 2


@query(
    "q126_curation_loop",
    f"""
    with g as (select unnest({_sql_list(GOALS)}) as goal), t as (select unnest({_sql_list(TOPICS)}) as topic), p as (select distinct n_name as persona from nation),
    c as (select goal, persona, topic, unnest(range(0, {TRIES})) as try_number from g, p, t),
    v as (select *, {below("goal || '#' || persona || '#' || topic || '#' || try_number", 'judge', '5')} < 3 as vote from c)
    select goal, persona, topic, count(*) filter (where vote) as n_yes, min(try_number) filter (where vote) as first_try, 'You are from ' || persona || '. ' || upper(left(goal, 1)) || substr(goal, 2) || ' while you talk about ' || topic || '.' as prompt
    from v group by 1, 2, 3 having count(*) filter (where vote) >= {NEEDED}""",
)
def curation_loop(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of goals, personas and topics (fixed lists and a table of 25 rows), judged in several tries; those with enough votes become prompts."""
    base = table(spark, d, "nation").select(F.col("n_name").alias("persona")).distinct()
    combos = base.withColumn("goal", F.explode(F.array(*map(F.lit, GOALS)))).withColumn("topic", F.explode(F.array(*map(F.lit, TOPICS)))).withColumn("try_number", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    vote = md5_below(F.concat_ws("#", "goal", "persona", "topic", "try_number"), "judge", 5) < 3
    judged = combos.withColumn("vote", vote).groupBy("goal", "persona", "topic").agg(F.count_if("vote").alias("n_yes"), F.min(F.when(F.col("vote"), F.col("try_number"))).cast("bigint").alias("first_try")).where(F.col("n_yes") >= NEEDED)
    prompt = text.fill("You are from {}. {} while you talk about {}.", F.col("persona"), F.concat(F.upper(F.left("goal", F.lit(1))), F.expr("substr(goal, 2)")), F.col("topic"))
    return judged.select("goal", "persona", "topic", "n_yes", "first_try", prompt.alias("prompt"))
