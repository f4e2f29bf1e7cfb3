"""Text folding, tag and name parsing, request keys, duplicates, existence and migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import udtf
from weftline.functions import sequences as seq
from weftline.functions import text
from weftline.operators import cache, joins
from weftline.plans.dialect import TURNS, below, tokens as sql_tokens
from weftline.plans.registry import query
from weftline.rand import md5_below
from weftline.storage import table

_FOLD = f"trim(regexp_replace(lower(translate({{}}, '{text.ACCENTED}', '{text.PLAIN}')), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query(
    "q67_unicode_fold_match",
    f"""
    with d as (select doc_id, {_FOLD.format("replace(text, chr(304), 'I')")} as folded from documents where lang in ('fr', 'de', 'es', 'pt', 'it', 'pl') and text is not null)
    select doc_id, md5(folded) as folded_md5, contains(folded, 'modelo') or contains(folded, 'modele') as has_model from d""",
)
def fold_match(spark: SparkSession, d: str) -> DataFrame:
    """Accents off, signs to blanks, then containment (the Latin subset, wholly in the JVM)."""
    docs = table(spark, d, "documents").where(F.col("lang").isin("fr", "de", "es", "pt", "it", "pl") & F.col("text").isNotNull())
    f = docs.select("doc_id", text.fold_latin(F.replace("text", F.lit("İ"), F.lit("I"))).alias("folded"))
    return f.select("doc_id", F.md5("folded").alias("folded_md5"), (F.contains("folded", F.lit("modelo")) | F.contains("folded", F.lit("modele"))).alias("has_model"))


_TAGGED = """
'<question> Is it ' || source || '?</question><answer>Yes</answer>' || chr(10) || '<question>Is it
 blank?</question><answer> no </answer><question>a</question><answer>YES</answer>' ||
case when doc_id % 3 = 0 then '<question>b</question><answer>maybe</answer>' when doc_id % 3 = 1 then '<question>b</question><answer>No</answer>' else '' end || '<final>one</final> <final>' || lang || '</final>'
"""


@query(
    "q73_tag_parse",
    f"""
    with d as (select doc_id, {_TAGGED.replace("lang", "coalesce(lang, '-')").replace("source", "coalesce(source, '-')")} as t from documents),
    p as (select doc_id, t, list_transform(regexp_extract_all(t, '(?s)<question>(.*?)</question>', 1), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) as q,
      list_transform(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1), lambda x: lower(trim(regexp_replace(x, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '))) as a from d),
    g as (select *, len(q) = 4 and len(a) = 4 and len(list_filter(a, lambda x: x = 'yes')) = 2 and len(list_filter(a, lambda x: x = 'no')) = 2 as good from p),
    l as (select *, string_split(t, '<final>') as f from g)
    select doc_id, good, case when good then array_to_string(list_transform(range(1, len(q) + 1), lambda i: q[i] || '=' || a[i]), ';') end as pairs, trim(string_split(f[-1], '</final>')[1], ' ') as final from l""",
)
def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    """Paired tags, just four with two of each answer, else rejected; and the last open tag."""
    lang, source = F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))
    r = F.col("doc_id") % 3
    tail = F.when(r == 0, "<question>b</question><answer>maybe</answer>").when(r == 1, "<question>b</question><answer>No</answer>").otherwise("")
    t = F.concat(
        F.lit("<question> Is it "), source, F.lit("?</question><answer>Yes</answer>\n<question>Is it\n blank?</question><answer> no </answer><question>a</question><answer>YES</answer>"),
        tail, F.lit("<final>one</final> <final>"), lang, F.lit("</final>"),
    )
    p = table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("p", text.tagged_pairs(F.col("t")))
    return p.select(
        "doc_id", F.col("p").isNotNull().alias("good"), F.array_join(F.transform("p", lambda x: F.concat(x["question"], F.lit("="), x["answer"])), ";").alias("pairs"),
        text.after_last_open_tag(F.col("t"), "final").alias("final"),
    )


@query(
    "q74_parse_names",
    """
    with n as (select distinct config_id, dataset_name, model_name, 'runs/' || lower(trim(dataset_name, ' ')) || '/lr_' || (1 + config_id % 3) || 'e-5_mi' || (config_id % 50) || '__run' || (config_id % 7) as path from dataset_loader_configs)
    select config_id, regexp_extract(path, '([^/]*)$', 1) as leaf, cast(regexp_extract(path, 'lr_([0-9]+e-?[0-9]+)', 1) as double) as lr, cast(regexp_extract(path, '__?run([0-9]+)$', 1) as int) as run,
      cast(regexp_extract(path, 'mi([0-9]+)__', 1) as int) as mi, translate(model_name, '/. ', '___') as safe, regexp_replace(lower(trim(dataset_name, ' ')), '^classification_', '') as short_name,
      upper(substr(replace(lower(trim(dataset_name, ' ')), '_', ' '), 1, 1)) || substr(replace(lower(trim(dataset_name, ' ')), '_', ' '), 2) as title, left(path, 12) as label,
      regexp_replace(regexp_extract(split_part('img/' || model_name || '.jpg#0', '#', 1), '([^/]*)$', 1), '[.][A-Za-z0-9]+$', '') as stem from n""",
)
def parse_names(spark: SparkSession, d: str) -> DataFrame:
    """Fields read off run and file names."""
    name = F.lower(F.trim("dataset_name"))
    path = F.concat(F.lit("runs/"), name, F.lit("/lr_"), 1 + F.col("config_id") % 3, F.lit("e-5_mi"), F.col("config_id") % 50, F.lit("__run"), F.col("config_id") % 7)
    n = table(spark, d, "dataset_loader_configs").select("config_id", name.alias("name"), "model_name", path.alias("path")).distinct()
    p = F.col("path")
    return n.select(
        "config_id", text.last_segment(p).alias("leaf"), text.learning_rate(p).alias("lr"), text.run_index(p).alias("run"), F.regexp_extract(p, "mi(\\d+)__", 1).cast("int").alias("mi"),
        text.safe_name(F.col("model_name")).alias("safe"), F.regexp_replace("name", "^classification_", "").alias("short_name"), text.capitalise(F.col("name")).alias("title"), F.left(p, F.lit(12)).alias("label"),
        text.stem(F.concat(F.lit("img/"), "model_name", F.lit(".jpg#0"))).alias("stem"),
    )


@query(
    "q75_request_cache",
    """
    with r as (select distinct verbalizer_prompt as prompt from verbalizer_results where verbalizer_prompt is not null),
    k as (select prompt, sha1(prompt || chr(1) || 'greedy') as key from r),
    c as (select sha1(prompt || chr(1) || 'greedy') as key, 'new:' || length(prompt) as response from r where length(prompt) % 2 = 0)
    select k.prompt, k.key, c.key is not null as hit, coalesce(c.response, 'provider:' || length(k.prompt)) as response from k left join c on c.key = k.key""",
)
def request_cache(spark: SparkSession, d: str) -> DataFrame:
    """Earlier responses by key, the last one written wins; what is missing goes to the provider once."""
    prompts = table(spark, d, "verbalizer_results").where("verbalizer_prompt is not null").select(F.col("verbalizer_prompt").alias("prompt")).distinct()
    stored = prompts.where(F.length("prompt") % 2 == 0).select(text.request_key(F.col("prompt"), F.lit("greedy")).alias("key"), F.explode(F.array(F.lit("old:"), F.lit("new:"))).alias("kind"), F.length("prompt").alias("n"))
    earlier = stored.select("key", F.concat("kind", "n").alias("response"), F.when(F.col("kind") == "old:", 1).otherwise(2).alias("seq"))
    provider = lambda p: "provider:" + p.str.len().astype(str)
    return cache.cached(prompts, earlier, "prompt", provider, F.lit("greedy"))[0].select("prompt", "key", "hit", "response")


@query(
    "q76_dedup_distinct_by",
    f"""
    with d as (select doc_id, md5(coalesce(text, '')) as h from documents),
    f as (select h, min(doc_id) as first_id, count(*) as copies from d group by h)
    select first_id, copies, {below('first_id', 'pair', '1000')} as draw from f""",
)
def dedup_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text and how often the text occurs."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    firsts = joins.distinct_by(docs, "h", "doc_id")
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("copies"))
    return firsts.join(copies, "h").select(F.col("doc_id").alias("first_id"), "copies", md5_below("doc_id", "pair", 1000).alias("draw"))


@query(
    "q77_existence_join",
    """
    with t as (select distinct doc_id from training_datapoints where doc_id is not null),
    c as (select doc_id, case when exists (select 1 from t where t.doc_id = d.doc_id) then d.doc_id when exists (select 1 from t where t.doc_id = d.doc_id + 1) then d.doc_id + 1 when exists (select 1 from t where t.doc_id = d.doc_id + 2) then d.doc_id + 2 end as found from documents d)
    select doc_id, doc_id in (select doc_id from t) as used, found from c""",
)
def existence_join(spark: SparkSession, d: str) -> DataFrame:
    """Semi and anti joins side by side, and the first existing one of several candidates."""
    docs = table(spark, d, "documents").select("doc_id")
    used = table(spark, d, "training_datapoints").where("doc_id is not null").select("doc_id").distinct()
    semi = docs.join(used, "doc_id", "left_semi").withColumn("used", F.lit(True))
    anti = docs.join(used, "doc_id", "left_anti").withColumn("used", F.lit(False))
    first = joins.first_candidate(docs, [F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 2], used.withColumnRenamed("doc_id", "found"), "found")
    return semi.unionByName(anti).join(first, "doc_id", "left")


@query(
    "q81_first_turns",
    f"""
    with {TURNS},
    u as (select point_id, min(pos) as p from turns where role = 'user' group by 1),
    a as (select t.point_id, min(t.pos) as q from turns t join u on u.point_id = t.point_id where t.role = 'assistant' and t.pos > u.p group by 1)
    select u.point_id, trim(regexp_replace(x.content, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') as question, trim(regexp_replace(y.content, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') as answer, len({sql_tokens('x.content')}) as n_words
    from u join turns x on x.point_id = u.point_id and x.pos = u.p left join a on a.point_id = u.point_id left join turns y on y.point_id = u.point_id and y.pos = a.q""",
)
def first_turns(spark: SparkSession, d: str) -> DataFrame:
    """The first user turn and the first assistant turn after it, squeezed."""
    from weftline.plans.sequences import dialogs

    at = F.array_position(F.transform("dialog", lambda t: t["role"] == "user"), True).cast("int")
    rows = dialogs(spark, d).withColumn("at", at).where("at > 0")
    after = F.get(F.filter(F.slice("dialog", F.col("at") + 1, F.greatest(F.size("dialog") - F.col("at"), F.lit(0))), lambda t: t["role"] == "assistant"), F.lit(0))["content"]
    said = F.try_element_at("dialog", F.col("at"))["content"]
    return rows.select("point_id", text.squeeze(said).alias("question"), text.squeeze(after).alias("answer"), F.size(text.tokens(said)).cast("bigint").alias("n_words"))


@query(
    "q89_schema_migration",
    """
    with o as (select distinct result_id, ground_truth, verbalizer_prompt from verbalizer_results),
    j as (select result_id, case when result_id % 2 = 0 then json_object('target', ground_truth, 'prompt', verbalizer_prompt) else json_object('ground_truth', ground_truth, 'verbalizer_prompt', verbalizer_prompt, 'version', 2) end as record from o)
    select result_id, coalesce(json_extract_string(record, '$.target'), json_extract_string(record, '$.ground_truth')) as target, coalesce(json_extract_string(record, '$.prompt'), json_extract_string(record, '$.verbalizer_prompt')) as prompt,
      coalesce(cast(json_extract_string(record, '$.version') as int), 1) as version from j""",
)
def schema_migration(spark: SparkSession, d: str) -> DataFrame:
    """Two record versions with different keys read into one schema."""
    rows = table(spark, d, "verbalizer_results").select("result_id", "ground_truth", "verbalizer_prompt").distinct()
    old = F.to_json(F.struct(F.col("ground_truth").alias("target"), F.col("verbalizer_prompt").alias("prompt")))
    new = F.to_json(F.struct("ground_truth", "verbalizer_prompt", F.lit(2).alias("version")))
    record = F.from_json(F.when(F.col("result_id") % 2 == 0, old).otherwise(new), "target string, ground_truth string, prompt string, verbalizer_prompt string, version int")
    parsed = rows.select("result_id", record.alias("r"))
    return parsed.select("result_id", F.coalesce("r.target", "r.ground_truth").alias("target"), F.coalesce("r.prompt", "r.verbalizer_prompt").alias("prompt"), F.coalesce("r.version", F.lit(1)).alias("version"))


@query(
    "q90_route_by_pattern",
    """
    with n as (select distinct config_id, lower(model_name) as m from dataset_loader_configs)
    select config_id, case when contains(m, '-7b') then 'small' when contains(m, '-32b') then 'large' when contains(m, 'b') then 'other' end as route from n""",
)
def route_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """The first route whose pattern the model's name contains."""
    rows = table(spark, d, "dataset_loader_configs").select("config_id", "model_name").distinct()
    return joins.route(rows, "model_name", [("-7b", "small"), ("-32b", "large"), ("b", "other")], "route").select("config_id", "route")


@query(
    "q91_zip_join",
    """
    with a as (select config_id, row_number() over (order by config_id) as r from (select distinct config_id from dataset_loader_configs)),
    b as (select r_regionkey, row_number() over (order by r_regionkey) as r from region)
    select config_id, r_regionkey, config_id is not null and r_regionkey is not null as same_length from a full join b on a.r = b.r""",
)
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Positional join; rows beyond the shorter side are marked."""
    configs = table(spark, d, "dataset_loader_configs").select("config_id").distinct()
    return joins.zip_rows(configs, table(spark, d, "region").select("r_regionkey"), "config_id", "r_regionkey")


@query(
    "q92_map_functions",
    """
    with p as (select point_id, any_value(meta_info) as m from training_datapoints group by point_id)
    select point_id, coalesce(m['run'], 'none') as run, coalesce(cardinality(m), 0) as n_keys, coalesce(array_to_string(list_sort(list_transform(map_keys(m), lambda k: 'meta_' || k)), ','), '') as renamed from p""",
)
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Get with default, size and renamed keys of a metadata map."""
    p = table(spark, d, "training_datapoints").dropDuplicates(["point_id"])
    renamed = F.array_sort(F.map_keys(F.transform_keys("meta_info", lambda k, v: F.concat(F.lit("meta_"), k))))
    return p.select("point_id", F.coalesce(F.try_element_at("meta_info", F.lit("run")), F.lit("none")).alias("run"), F.coalesce(F.cardinality("meta_info"), F.lit(0)).cast("bigint").alias("n_keys"), F.coalesce(F.array_join(renamed, ","), F.lit("")).alias("renamed"))


@query(
    "q93_token_activations",
    f"""
    with d as (select doc_id, {sql_tokens('text')} as t from documents),
    a as (select doc_id, list_transform(range(1, len(t) + 1), lambda i: t[i] || ' (' || printf('%.2f', case when length(t[i]) > 5 then length(t[i]) * 0.25 else 0.0 end) || ')') as x from d where len(t) > 0)
    select doc_id, array_to_string(x, ' ') as rendered, array_to_string(list_transform(range(1, len(x) + 1), lambda i: 'Example ' || i || ': ' || x[i]), chr(10)) as listed from a""",
)
def token_activations(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with sparse activations (absent ones are 0.00) and numbered lists."""
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).where("size(t) > 0")
    act = F.transform("t", lambda s: F.struct(s.alias("s"), F.when(F.length(s) > 5, F.length(s) * 0.25).cast("double").alias("act")))
    shown = docs.withColumn("a", act).select("doc_id", seq.token_activations(F.col("a")).alias("rendered"), F.transform("a", lambda v: F.concat(v["s"], F.format_string(" (%.2f)", F.coalesce(v["act"], F.lit(0.0))))).alias("x"))
    return shown.select("doc_id", "rendered", text.numbered(F.col("x")).alias("listed"))


@query(
    "q129_sentence_table",
    r"""
    with d as (select doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n]+', '\1' || chr(57344), 'g'), chr(57344)) as parts from documents where text is not null),
    s as (select doc_id, list_filter(parts, lambda p: regexp_matches(p, '[^ \t\n]')) as parts from d)
    select doc_id, cast(len(parts) as bigint) as n_sentences, cast(list_sum(list_transform(parts, lambda p: length(p))) as bigint) as n_chars, md5(parts[1]) as first from s where len(parts) > 0""",
)
def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their places by a table function in SQL."""
    udtf.register(spark)
    view = f"sentences_of_{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView(view)
    rows = spark.sql(f"select doc_id, s.* from {view}, lateral sentences(text) as s")
    cut = F.col("end_pos") - F.col("begin_pos")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(cut).alias("n_chars"), F.md5(F.min_by("sentence", "sentence_no")).alias("first"))
