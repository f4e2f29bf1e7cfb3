"""Question sets and true/false statements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import base64_tag, capitalise, decapitalise, fill
from weftline.operators import joins, order, sampling
from weftline.plans.dialect import below, int32, key
from weftline.plans.registry import query
from weftline.rand import md5_below, md5_int
from weftline.ranks import shuffled_rank
from weftline.storage import table

#: Fixed value: the instruction before a question that is answered with one word.
YES_NO = "Answer with 'Yes' or 'No' only."

PARAPHRASES = ["Is this text written in {}?", "Would you say that the language is {}?", "Does the writer use {}?"]


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _label_qa(rows: DataFrame, id_: str, label: str, paraphrases: list[str], salt: str) -> DataFrame:
    """Two paraphrases a row, each asking for the right label or for another one."""
    options = rows.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("options"))
    asked = rows.crossJoin(F.broadcast(options)).withColumn("p", F.explode(sampling.some_of(F.array(*[F.lit(p) for p in paraphrases]), 2, id_, salt + ".phrase")))
    k = F.concat_ws("#", id_, "p")
    drawn = asked.withColumn("d", sampling.right_or_wrong(F.col("options"), F.col(label), k, salt))
    return drawn.select(id_, F.replace("p", F.lit("{}"), F.col("d.shown")).alias("question"), F.col("d.answer").alias("answer"), F.col(label).alias("ds_label"))


def _label_qa_sql(rows: str, id_: str, label: str, paraphrases: list[str], salt: str) -> str:
    k = f"{id_} || '#' || p"
    return f"""
    with l as ({rows}), o as (select list_sort(list(distinct {label})) as options from l),
    p as (select unnest({_sql_list(paraphrases)}) as p),
    r as (select l.*, p.p, row_number() over (partition by {id_} order by {key(f"{id_} || '#' || p", salt + '.phrase')}) as rn from l, p),
    w as (select r.*, list_filter(options, lambda x: x <> {label}) as others from r, o where rn <= 2),
    c as (select *, len(others) > 0 and {below(k, salt + '.coin', '2')} = 1 as lie, others[1 + {below(k, salt + '.other', 'greatest(len(others), 1)')}] as other from w)
    select {id_}, replace(p, '{{}}', case when lie then other else {label} end) as question, case when lie then 'No' else 'Yes' end as answer, {label} as ds_label from c"""


@query("q10_lang_id_qa", _label_qa_sql("select doc_id, lang from documents where regexp_full_match(lang, '[a-z]{2}') and lang <> 'xx'", "doc_id", "lang", PARAPHRASES, "lang"))
def lang_id_qa(spark: SparkSession, d: str) -> DataFrame:
    """Language questions; the label set is that of two-letter codes, so at most 676 values are broadcast."""
    rows = table(spark, d, "documents").select("doc_id", "lang").where(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "xx"))
    return _label_qa(rows, "doc_id", "lang", PARAPHRASES, "lang")


@query("q19_topic_qa", _label_qa_sql("select c_custkey, c_mktsegment from customer", "c_custkey", "c_mktsegment", ["Is this about {}?", "Is the topic {}?", "Would {} describe it?"], "topic"))
def topic_qa(spark: SparkSession, d: str) -> DataFrame:
    return _label_qa(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", ["Is this about {}?", "Is the topic {}?", "Would {} describe it?"], "topic")


@query(
    "q11_binary_label_qa",
    """
    with s as (select distinct sample_id, questions, answers from context_qa_samples where context is not null and len(questions) = len(answers)),
    e as (select sample_id, unnest(range(1, len(questions) + 1)) as i, questions, answers from s)
    select sample_id, i - 1 as question_no, 'Answer with ''Yes'' or ''No'' only. ' || regexp_replace(questions[i], '^# ', '') as question,
      case when lower(trim(answers[i], ' ')) in ('1', 'true', 'yes') then 'Yes' else 'No' end as answer
    from e where questions[i] is not null and answers[i] is not null""",
)
def binary_label_qa(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays flattened to one row a question; rows whose arrays differ in length are left out."""
    rows = table(spark, d, "context_qa_samples").where("context is not null and size(questions) = size(answers)").select("sample_id", "questions", "answers").distinct()
    flat = rows.select("sample_id", F.posexplode(F.arrays_zip("questions", "answers")).alias("question_no", "z")).where("z.questions is not null and z.answers is not null")
    truthy = F.lower(F.trim("z.answers")).isin("1", "true", "yes")
    text = F.concat(F.lit(f"{YES_NO} "), F.regexp_replace("z.questions", "^# ", ""))
    return flat.select("sample_id", F.col("question_no").cast("bigint").alias("question_no"), text.alias("question"), F.when(truthy, "Yes").otherwise("No").alias("answer"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    options = region.agg(F.array_sort(F.collect_set("r_name")).alias("options"))
    facts = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name").crossJoin(F.broadcast(options))
    wrong = sampling.other_than(F.col("options"), F.col("r_name"), "n_nationkey", "relation")
    say = lambda place: fill("The nation {} lies in {}.", F.col("n_name"), place)
    both = F.array(F.struct(say(F.col("r_name")).alias("statement"), F.lit(1).alias("label")), F.struct(say(wrong).alias("statement"), F.lit(0).alias("label")))
    return facts.select("n_nationkey", F.explode(both).alias("s")).select("n_nationkey", "s.statement", "s.label")


_RELATIONS = f"""
f as (select n_nationkey, n_name, r_name, list_filter(options, lambda x: x <> r_name) as others
  from nation join region on n_regionkey = r_regionkey, (select list_sort(list(distinct r_name)) as options from region)),
rel as (
  select n_nationkey, 'The nation ' || n_name || ' lies in ' || r_name || '.' as statement, 1 as label from f
  union all
  select n_nationkey, 'The nation ' || n_name || ' lies in ' || others[1 + {below('n_nationkey', 'relation', 'len(others)')}] || '.', 0 from f)
"""


@query("q14_relation_true_false", f"with {_RELATIONS} select * from rel")
def relation_true_false(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d)


@query(
    "q15_city_statements_negated",
    f"""
    with once as (select *, count(*) over (partition by s_name) as c from supplier),
    f as (select s_suppkey, s_name, n_name, list_filter(options, lambda x: x <> n_name) as others from once join nation on s_nationkey = n_nationkey,
      (select list_sort(list(distinct n_name)) as options from nation) where c = 1 and s_acctbal > 500 and not contains(n_name, s_name)),
    t as (select s_suppkey, s_name, n_name as place, 1 as label from f union all select s_suppkey, s_name, others[1 + {below('s_suppkey', 'city', 'len(others)')}], 0 from f)
    select s_suppkey, 'The firm ' || s_name || ' is in ' || place || '.' as statement, label, 'The firm ' || s_name || ' is not in ' || place || '.' as neg_statement, 1 - label as neg_label from t""",
)
def city_statements(spark: SparkSession, d: str) -> DataFrame:
    """Names that occur once (counted before filtering), a true and a false place for each, and the negated twin with the flipped label."""
    nation = table(spark, d, "nation")
    options = nation.agg(F.array_sort(F.collect_set("n_name")).alias("options"))
    kept = joins.names_once(table(spark, d, "supplier"), "s_name").where("s_acctbal > 500")
    facts = kept.join(nation, kept["s_nationkey"] == nation["n_nationkey"]).where(~F.contains("n_name", F.col("s_name"))).crossJoin(F.broadcast(options))
    wrong = sampling.other_than(F.col("options"), F.col("n_name"), "s_suppkey", "city")
    rows = facts.select("s_suppkey", "s_name", F.explode(F.array(F.struct(F.col("n_name").alias("place"), F.lit(1).alias("label")), F.struct(wrong.alias("place"), F.lit(0).alias("label")))).alias("x"))
    return rows.select(
        "s_suppkey", fill("The firm {} is in {}.", F.col("s_name"), F.col("x.place")).alias("statement"), F.col("x.label").alias("label"),
        fill("The firm {} is not in {}.", F.col("s_name"), F.col("x.place")).alias("neg_statement"), (1 - F.col("x.label")).alias("neg_label"),
    )


@query(
    "q16_number_comparisons",
    """
    with n as (select unnest(range(50, 100)) as v), k as (select v from n where v % 10 <> 0)
    select a.v as first, b.v as second, w.w as word, case when w.w = 'larger' then a.v > b.v else a.v < b.v end as label, a.v - b.v as diff, abs(a.v - b.v) as abs_diff
    from k a, k b, (select unnest(['larger', 'smaller']) as w) w where a.v <> b.v""",
)
def number_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Every ordered pair of a fixed list of 45 numbers: the product is of constant size."""
    numbers = spark.range(50, 100).where("id % 10 <> 0")
    a, b = numbers.withColumnRenamed("id", "first"), numbers.withColumnRenamed("id", "second")
    pairs = a.join(F.broadcast(b), F.col("first") != F.col("second")).withColumn("word", F.explode(F.array(F.lit("larger"), F.lit("smaller"))))
    label = F.when(F.col("word") == "larger", F.col("first") > F.col("second")).otherwise(F.col("first") < F.col("second"))
    return pairs.select("first", "second", "word", label.alias("label"), (F.col("first") - F.col("second")).alias("diff"), F.abs(F.col("first") - F.col("second")).alias("abs_diff"))


CONJ_N = 400
_P = math.sqrt(0.5)
CONJ_QUOTAS = {(1, 1): int(_P * _P * CONJ_N), (1, 0): int(_P * (1 - _P) * CONJ_N), (0, 1): int(_P * (1 - _P) * CONJ_N), (0, 0): int((1 - _P) ** 2 * CONJ_N)}


@query(
    "q17_conj_disj",
    f"""
    with {_RELATIONS},
    g as (select *, row_number() over (partition by label order by {key('statement', 'conj')}, statement) as ord, count(*) over (partition by label) as c from rel),
    q as (select unnest([{', '.join(f'{{a: {a}, b: {b}, n: {n}}}' for (a, b), n in CONJ_QUOTAS.items())}]) as q),
    d as (select q.a, q.b, unnest(range(0, q.n)) as draw from q),
    k as (select d.*, {below("a || '#' || b || '#' || draw", 'conj.1', '(select any_value(c) from g where label = 1)')} as x0, {below("a || '#' || b || '#' || draw", 'conj.2', '(select any_value(c) from g where label = 1)')} as y0 from d)
    select k.a as label1, k.b as label2, draw, 'It is the case both that ' || lower(left(u.statement, 1)) || substr(u.statement, 2, greatest(length(u.statement) - 2, 0)) || ' and that ' || lower(left(v.statement, 1)) || substr(v.statement, 2, greatest(length(v.statement) - 2, 0)) || '.' as conj,
      'It is the case either that ' || lower(left(u.statement, 1)) || substr(u.statement, 2, greatest(length(u.statement) - 2, 0)) || ' or that ' || lower(left(v.statement, 1)) || substr(v.statement, 2, greatest(length(v.statement) - 2, 0)) || '.' as disj,
      k.a * k.b as conj_label, greatest(k.a, k.b) as disj_label
    from k join g u on u.label = k.a and u.ord = x0 + 1 join g v on v.label = k.b and v.ord = y0 + 1""",
)
def conj_disj(spark: SparkSession, d: str) -> DataFrame:
    """Statements paired by label with replacement, in fixed quotas; first letters lowered and full stops cut."""
    rel = _relations(spark, d)
    ranked = shuffled_rank(rel, "statement", "conj", ["label"], rank="ord")
    n = rel.where("label = 1").agg(F.count(F.lit(1)).alias("c"))
    quotas = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(q).alias("n")) for (a, b), q in CONJ_QUOTAS.items()])
    draws = n.select("c", F.explode(quotas).alias("q")).select("c", "q.*").withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    k = F.concat_ws("#", "a", "b", "draw")
    placed = draws.withColumn("x", md5_below(k, "conj.1", F.col("c")) + 1).withColumn("y", md5_below(k, "conj.2", F.col("c")) + 1)
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("label"), F.col("x").alias("ord")), F.struct(F.lit(2).alias("side"), F.col("b").alias("label"), F.col("y").alias("ord"))))
    asked = placed.select("a", "b", "draw", sides.alias("s")).select("a", "b", "draw", "s.side", "s.label", "s.ord")  # two rows a draw, whatever the tables
    found = ranked.join(F.broadcast(asked), ["label", "ord"]).withColumn("statement", decapitalise(F.col("statement")))
    part = lambda side: F.max(F.when(F.col("side") == side, F.col("statement")))
    pairs = found.groupBy("a", "b", "draw").agg(part(1).alias("s1"), part(2).alias("s2")).where("s1 is not null and s2 is not null")
    return pairs.select(
        F.col("a").alias("label1"), F.col("b").alias("label2"), F.col("draw"),
        fill("It is the case both that {} and that {}.", F.col("s1"), F.col("s2")).alias("conj"),
        fill("It is the case either that {} or that {}.", F.col("s1"), F.col("s2")).alias("disj"),
        (F.col("a") * F.col("b")).alias("conj_label"), F.greatest("a", "b").alias("disj_label"),
    )


@query(
    "q18_counterfact_pairs",
    f"""
    with o as (select list_sort(list(distinct p_brand)) as options from part),
    f as (select p_partkey, p_type, p_brand, list_filter(options, lambda x: x <> p_brand) as others from part, o where p_size between 5 and 40)
    select p_partkey, replace('The brand of {{}} is ', '{{}}', p_type) || p_brand || '.' as statement, 1 as label from f
    union all select p_partkey, replace('The brand of {{}} is ', '{{}}', p_type) || others[1 + {below('p_partkey', 'counter', 'greatest(len(others), 1)')}] || '.', 0 from f where len(others) > 0""",
)
def counterfact_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    options = part.agg(F.array_sort(F.collect_set("p_brand")).alias("options"))
    rows = part.where("p_size between 5 and 40").crossJoin(F.broadcast(options))
    wrong = sampling.other_than(F.col("options"), F.col("p_brand"), "p_partkey", "counter")
    prompt = fill("The brand of {} is ", F.col("p_type"))
    stacked = F.array(F.struct(F.col("p_brand").alias("b"), F.lit(1).alias("label")), F.struct(wrong.alias("b"), F.lit(0).alias("label")))
    return rows.withColumn("x", F.explode(stacked)).where("x.b is not null").select("p_partkey", F.concat(prompt, F.col("x.b"), F.lit(".")).alias("statement"), F.col("x.label").alias("label"))


ASK_POSITIVE = ["Is the mood of this bright?", "Does the writer sound pleased?", "Is this a kind remark?"]
ASK_NEGATIVE = ["Is the mood of this dark?", "Does the writer sound annoyed?", "Is this an unkind remark?"]


@query(
    "q20_sentiment_aligned_paraphrase",
    f"""
    with l as (select distinct sample_id, lower(trim(ds_label, ' ')) as label from context_qa_samples where lower(trim(ds_label, ' ')) in ('positive', 'negative')),
    k as (select *, {below('sample_id', 'mood.i', '3')} as i, {below('sample_id', 'mood.ask', '2')} as ask from l)
    select sample_id, case when ask = 1 then {_sql_list(ASK_POSITIVE)}[1 + i] else {_sql_list(ASK_NEGATIVE)}[1 + i] end as question,
      case when (ask = 1) = (label = 'positive') then 'Yes' else 'No' end as answer, label as ds_label from k""",
)
def sentiment_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The list of paraphrases follows the asked label, index by index."""
    label = F.lower(F.trim("ds_label"))
    rows = table(spark, d, "context_qa_samples").select("sample_id", label.alias("label")).where(F.col("label").isin("positive", "negative")).distinct()
    i, ask = md5_below("sample_id", "mood.i", 3).cast("int"), md5_below("sample_id", "mood.ask", 2) == 1
    lists = [F.array(*[F.lit(x) for x in xs]) for xs in (ASK_POSITIVE, ASK_NEGATIVE)]
    return rows.select("sample_id", F.when(ask, F.get(lists[0], i)).otherwise(F.get(lists[1], i)).alias("question"), F.when(ask == (F.col("label") == "positive"), "Yes").otherwise("No").alias("answer"), F.col("label").alias("ds_label"))


@query(
    "q22_nli_binary",
    """
    select distinct sample_id, 'Premise: ' || context || ' Does it follow?' as prompt, case lower(trim(ds_label, ' ')) when 'entailment' then 'Yes' else 'No' end as answer
    from context_qa_samples where lower(trim(ds_label, ' ')) in ('entailment', 'contradiction') and context is not null""",
)
def nli_binary(spark: SparkSession, d: str) -> DataFrame:
    """Codes mapped to answers, the neutral one dropped."""
    answers = F.create_map(F.lit("entailment"), F.lit("Yes"), F.lit("contradiction"), F.lit("No"))
    rows = table(spark, d, "context_qa_samples").withColumn("answer", F.element_at(answers, F.lower(F.trim("ds_label")))).where("answer is not null and context is not null")
    return rows.select("sample_id", F.concat(F.lit("Premise: "), "context", F.lit(" Does it follow?")).alias("prompt"), "answer").distinct()


@query(
    "q23_persona_product",
    f"""
    with a as (select c_custkey, c_name, unnest([{{attr: 'market_segment', v: c_mktsegment}}, {{attr: 'home_nation', v: n_name}}]) as x from customer join nation on c_nationkey = n_nationkey),
    o as (select attr, list_sort(list(distinct v)) as options from (select x.attr as attr, x.v as v from a) group by attr),
    r as (select c_custkey, c_name, x.attr as attr, x.v as v, list_filter(options, lambda y: y <> x.v) as others from a join o on o.attr = a.x.attr),
    z as (select r.*, unnest(['Yes', 'No']) as expected from r)
    select c_custkey, attr, expected, 'Is the ' || replace(attr, '_', ' ') || ' of ' || c_name || ' ' || case when expected = 'Yes' then v else others[1 + {below("c_name || '#' || attr", 'persona', 'greatest(len(others), 1)')}] end || '?' as prompt
    from z""",
)
def persona_product(spark: SparkSession, d: str) -> DataFrame:
    """Persona x attribute x expected answer; a wrong value is drawn by the persona's name. The product adds a constant factor of rows."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    attrs = F.array(F.struct(F.lit("market_segment").alias("attr"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("home_nation").alias("attr"), F.col("n_name").alias("v")))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "c_name", F.explode(attrs).alias("x")).select("c_custkey", "c_name", "x.attr", "x.v")
    options = rows.groupBy("attr").agg(F.array_sort(F.collect_set("v")).alias("options"))
    wrong = sampling.other_than(F.col("options"), F.col("v"), F.concat_ws("#", "c_name", "attr"), "persona")
    both = rows.join(F.broadcast(options), "attr").withColumn("wrong", wrong).withColumn("expected", F.explode(F.array(F.lit("Yes"), F.lit("No"))))
    shown = F.when(F.col("expected") == "Yes", F.col("v")).otherwise(F.col("wrong"))
    return both.select("c_custkey", "attr", "expected", F.concat(F.lit("Is the "), F.replace("attr", F.lit("_"), F.lit(" ")), F.lit(" of "), "c_name", F.lit(" "), shown, F.lit("?")).alias("prompt"))


@query(
    "q24_persona_lookup_join",
    """
    select o_orderkey, '<|user|>' || c_name || chr(10) || '<|assistant|>' || o_orderpriority as messages, false as unmatched from orders join customer on o_custkey = c_custkey
    union all select o_orderkey, null, true from orders where o_custkey not in (select c_custkey from customer)""",
)
def persona_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Texts joined to their persona (the first row of a key); rows without one are shown, not lost."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    found = joins.lookup(orders, customer, "c_custkey", "c_name").select("o_orderkey", F.concat(F.lit("<|user|>"), "c_name", F.lit("\n<|assistant|>"), "o_orderpriority").alias("messages"), F.lit(False).alias("unmatched"))
    lost = orders.join(joins.missing_keys(orders, customer, "c_custkey"), "c_custkey", "left_semi").select("o_orderkey", F.lit(None).cast("string").alias("messages"), F.lit(True).alias("unmatched"))
    return found.unionByName(lost)


@query(
    "q25_attribute_topk",
    """
    with u as (select 'segment' as attr, c_mktsegment as v, c_custkey as k from customer union all select 'nation', cast(c_nationkey as varchar), c_custkey from customer union all select 'balance_band', cast(cast(floor(c_acctbal / 250) as bigint) as varchar), c_custkey from customer),
    c as (select attr, v, count(*) as n, min(k) as first_seen from u where v is not null group by 1, 2),
    r as (select *, row_number() over (partition by attr order by n desc, first_seen) as rank, count(*) over (partition by attr) as n_distinct from c)
    select attr, v, n, rank, n_distinct from r where rank <= 15""",
)
def attribute_topk(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts and the 15 most common values of each attribute, ties by first appearance."""
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_acctbal") / 250).cast("string").alias("balance_band"))
    long = customer.unpivot(["c_custkey"], ["segment", "nation", "balance_band"], "attr", "v").where("v is not null")
    counts = long.groupBy("attr", "v").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_seen"))
    kinds = counts.groupBy("attr").agg(F.count(F.lit(1)).alias("n_distinct"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("attr").orderBy(F.desc("n"), "first_seen"))).where("rank <= 15")
    return top.join(kinds, "attr").drop("first_seen")


@query(
    "q26_answer_first_qa",
    f"""
    with l as (select distinct sample_id, lower(trim(ds_label, ' ')) as label from context_qa_samples where lower(trim(ds_label, ' ')) in ('past', 'present', 'future', 'single', 'multiple', 'dual')),
    o as (select list_sort(list(distinct label)) as options from l),
    k as (select l.*, {below('sample_id', 'tense.answer', '2')} = 1 as yes, list_filter(options, lambda x: x <> label) as others from l, o)
    select sample_id, case when yes or len(others) = 0 then label else others[1 + {below('sample_id', 'tense.other', 'greatest(len(others), 1)')}] end as asked, case when yes or len(others) = 0 then 'Yes' else 'No' end as answer, label as ds_label from k""",
)
def answer_first_qa(spark: SparkSession, d: str) -> DataFrame:
    """The answer is drawn first, then a label that fits it."""
    label = F.lower(F.trim("ds_label"))
    rows = table(spark, d, "context_qa_samples").select("sample_id", label.alias("label")).where(F.col("label").isin("past", "present", "future", "single", "multiple", "dual")).distinct()
    options = rows.agg(F.array_sort(F.collect_set("label")).alias("options"))
    wrong = sampling.other_than(F.col("options"), F.col("label"), "sample_id", "tense.other")
    yes = (md5_below("sample_id", "tense.answer", 2) == 1) | F.col("wrong").isNull()
    return rows.crossJoin(F.broadcast(options)).withColumn("wrong", wrong).select("sample_id", F.when(yes, F.col("label")).otherwise(F.col("wrong")).alias("asked"), F.when(yes, "Yes").otherwise("No").alias("answer"), F.col("label").alias("ds_label"))


@query(
    "q27_shuffled_quota_qa",
    f"""
    with l as (select distinct sample_id, lower(trim(ds_label, ' ')) as label from context_qa_samples where lower(trim(ds_label, ' ')) in ('first_person', 'third_person')),
    m as (select count(*) as quota from l where label = 'third_person'),
    r as (select l.*, row_number() over (partition by label order by {key('sample_id', 'quota')}, sample_id) as rn from l)
    select sample_id, label, 'This text is about a ' || replace(label, '_', ' ') || '.' as suffix from r, m where label <> 'first_person' or rn <= quota""",
)
def shuffled_quota_qa(spark: SparkSession, d: str) -> DataFrame:
    """The majority label is cut, after a shuffle, to as many rows as the minority has."""
    label = F.lower(F.trim("ds_label"))
    rows = table(spark, d, "context_qa_samples").select("sample_id", label.alias("label")).where(F.col("label").isin("first_person", "third_person")).distinct()
    quota = rows.where("label = 'third_person'").agg(F.count(F.lit(1)).alias("quota"))
    ranked = shuffled_rank(rows, "sample_id", "quota", ["label"], rank="rn").crossJoin(F.broadcast(quota))
    suffix = F.concat(F.lit("This text is about a "), F.replace("label", F.lit("_"), F.lit(" ")), F.lit("."))
    return ranked.where("label <> 'first_person' or rn <= quota").select("sample_id", "label", suffix.alias("suffix"))


@query(
    "q28_fraction_min_one",
    f"""
    with r as (select point_id, row_number() over (order by {key('point_id', 'fraction')}, point_id) as rn, count(*) over () as n from (select distinct point_id from latentqa_datapoints))
    select point_id from r where rn <= greatest(1, cast(floor(n * 0.05) as bigint))""",
)
def fraction_min_one(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction(table(spark, d, "latentqa_datapoints").select("point_id").distinct(), "point_id", 0.05, salt="fraction")


@query(
    "q29_random_fields",
    f"""
    select doc_id, 3 + {int32('doc_id', 'layer')} % 8 as layer, ['past', 'future'][1 + {below('doc_id', 'direction', '2')}] as direction, {int32('doc_id', 'coin')} / 4294967296.0 < 0.5 as included,
      {below('doc_id', 'jitter', '5')} - 2 as jitter from documents""",
)
def random_fields(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive random whole numbers, a choice from a list and a fair coin, all from the key."""
    from weftline.rand import choose, md5_unit

    return table(spark, d, "documents").select(
        "doc_id", (3 + md5_int("doc_id", "layer") % 8).alias("layer"), choose(F.array(F.lit("past"), F.lit("future")), "doc_id", "direction").alias("direction"),
        (md5_unit("doc_id", "coin") < 0.5).alias("included"), (md5_below("doc_id", "jitter", 5) - 2).alias("jitter"),
    )


CONSTRAINTS = ["never name a colour", "answer in one line", "avoid the letter z"]


@query(
    "q78_secret_constraints",
    f"""
    with c as (select unnest([{', '.join(f"{{i: {i}, c: '{c}'}}" for i, c in enumerate(CONSTRAINTS))}]) as x)
    select distinct result_id, x.i as constraint_no, '<secret>' || to_base64(encode(x.c)) || '</secret> ' || verbalizer_prompt as prompt from verbalizer_results, c where verbalizer_prompt is not null""",
)
def secret_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Every context with every constraint of a fixed list; the constraint is hidden in a tag."""
    fixed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CONSTRAINTS)])
    rows = table(spark, d, "verbalizer_results").where("verbalizer_prompt is not null").select("result_id", "verbalizer_prompt").distinct().withColumn("x", F.explode(fixed))
    return rows.select("result_id", F.col("x.i").alias("constraint_no"), F.concat(base64_tag(F.col("x.c")), F.lit(" "), "verbalizer_prompt").alias("prompt"))


@query(
    "q79_zero_shot_tail",
    f"""
    with s as (select distinct sample_id, context, questions[1] as q from context_qa_samples where context is not null and len(questions) > 0 and questions[1] is not null),
    r as (select *, row_number() over (order by {key('sample_id', 'zero')}, sample_id) as ord, count(*) over () as n from s)
    select sample_id, context || chr(10) || upper(left(q, 1)) || substr(replace(q, '_', ' '), 2) as prompt from r where ord > n - 50""",
)
def zero_shot_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 contexts of a shuffle, each with its first question."""
    rows = table(spark, d, "context_qa_samples").where("context is not null and size(questions) > 0").select("sample_id", "context", F.get("questions", F.lit(0)).alias("q")).where("q is not null").distinct()
    tail = order.head_tail_split(rows, "sample_id", train=0, test=50, salt="zero").where("split = 'test'")
    return tail.select("sample_id", F.concat("context", F.lit("\n"), capitalise(F.col("q"))).alias("prompt"))
