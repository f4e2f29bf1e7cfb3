"""Queries over vectors: neighbours, norms, encoding, steering and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import vectors
from weftline.operators import evals, joins
from weftline.operators.neighbours import cosine_top_k, nearest_centroid
from weftline.plans.dialect import key
from weftline.plans.registry import query
from weftline.rand import md5_key
from weftline.ranks import lower_median, value_at_rank
from weftline.storage import table

_V = "e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))


@query(
    "q50_cosine_topk",
    f"""
    with {_V}, n as (select vec_id, v, {_NORM.format('v')} as n from e),
    s as (select a.vec_id, b.vec_id as neighbour, {_DOT.format('a.v', 'b.v')} / (a.n * b.n) as sim from n a, n b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by vec_id order by sim desc, neighbour) as rank from s)
    select vec_id, neighbour, rank, round(sim, 6) as similarity from r where rank <= 5""",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    rows = table(spark, d, "embeddings")
    near = cosine_top_k(rows.where("vec_id % 100 = 0"), rows, 5)
    return near.withColumn("similarity", F.round("similarity", 6))


@query(
    "q51_vector_norms_outliers",
    f"""
    with {_V}, n as (select vec_id, label, round({_NORM.format('v')}, 6) as norm from e),
    m as (select norm as med from (select norm, row_number() over (order by norm) as rn, count(*) over () as c from n) where rn = (c - 1) // 2 + 1)
    select vec_id, norm, norm < 10 * med and vec_id <> 0 as kept, abs(norm - 1) <= 0.05 as is_unit from n, m""",
)
def norms_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Norms against ten times the lower median, the first token aside, and a unit-norm test with tolerance."""
    n = embeddings(spark, d).select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"))
    med = value_at_rank(n, "norm", lower_median(), name="med", continuous=True).select("med")
    return n.crossJoin(F.broadcast(med)).select("vec_id", "norm", ((F.col("norm") < 10 * F.col("med")) & (F.col("vec_id") != 0)).alias("kept"), (F.abs(F.col("norm") - 1) <= 0.05).alias("is_unit"))


@query(
    "q52_standardize",
    f"""
    with {_V}, x as (select vec_id, unnest(range(0, len(v))) as dim, unnest(v) as x from e),
    s as (select dim, avg(x) as mu, greatest(stddev_samp(x), 1e-6) as sd from x where vec_id % 5 <> 0 group by dim)
    select x.dim, round(any_value(mu), 6) as mu, round(any_value(sd), 6) as sd, round(avg((x - mu) / sd), 6) as mean_z, round(max((x - mu) / sd), 6) as max_z
    from x join s on s.dim = x.dim where vec_id % 5 = 0 group by x.dim""",
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the training rows only, applied to the test rows; the statistics have one row a dimension."""
    x = embeddings(spark, d).select("vec_id", F.posexplode("v").alias("dim", "x"))
    s = x.where("vec_id % 5 <> 0").groupBy("dim").agg(F.avg("x").alias("mu"), F.greatest(F.stddev_samp("x"), F.lit(1e-6)).alias("sd"))
    z = (F.col("x") - F.col("mu")) / F.col("sd")
    test = x.where("vec_id % 5 = 0").join(s, "dim")
    return test.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.first("mu"), 6).alias("mu"), F.round(F.first("sd"), 6).alias("sd"), F.round(F.avg(z), 6).alias("mean_z"), F.round(F.max(z), 6).alias("max_z"))


FEATURES, ACTIVE = 16, 3


@query(
    "q53_sparse_encode",
    f"""
    with {_V}, f as (select vec_id as feature, v as w from e where vec_id in (select vec_id from embeddings order by vec_id limit {FEATURES})),
    a as (select vec_id, feature, round({_DOT.format('v', 'w')} - 0.1, 9) as x from e, f),
    t as (select *, case when x > 0.05 then greatest(x, 0.0) else 0.0 end as act from a),
    r as (select *, row_number() over (partition by vec_id order by act desc, feature) as rank from t where act > 0)
    select vec_id, feature, rank, round(act, 6) as act from r where rank <= {ACTIVE}""",
)
def sparse_encode(spark: SparkSession, d: str) -> DataFrame:
    """Affine map, threshold and ReLU onto a dictionary of fixed size, then the top features of each row."""
    e = embeddings(spark, d)
    dictionary = e.orderBy("vec_id").limit(FEATURES).agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("feature"), F.col("v").alias("w")))).alias("f"))
    scored = F.transform("f", lambda f: F.struct((-vectors.threshold_relu(F.round(vectors.dot(F.col("v"), f["w"]) - 0.1, 9), 0.05)).alias("neg"), f["feature"].alias("feature")))
    top = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, ACTIVE)
    rows = e.crossJoin(F.broadcast(dictionary)).select("vec_id", F.posexplode(top).alias("rank", "s"))
    return rows.select("vec_id", "s.feature", (F.col("rank") + 1).alias("rank"), F.round(-F.col("s.neg"), 6).alias("act"))


@query(
    "q54_steer",
    f"""
    with {_V}, dir as (select v as w from e where vec_id = (select min(vec_id) from embeddings)),
    s as (select vec_id, v, w, {_NORM.format('v')} as nv, {_NORM.format('w')} as nw from e, dir)
    select vec_id, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] + w[i] * nv * 2 / nw) * (v[i] + w[i] * nv * 2 / nw)))), 6) as added_norm,
      round(nv * 2, 6) as replaced_norm, round(nv * 2, 6) as delta_norm from s""",
)
def steer(spark: SparkSession, d: str) -> DataFrame:
    """A direction scaled to each row's norm: added to it, or put in its place."""
    e = embeddings(spark, d)
    direction = e.agg(F.min_by("v", "vec_id").alias("w"))
    s = e.crossJoin(F.broadcast(direction))
    added = s.withColumn("a", vectors.steer_add(F.col("v"), F.col("w"), 2.0)).withColumn("r", vectors.steer_replace(F.col("v"), F.col("w"), 2.0))
    return added.select("vec_id", F.round(vectors.norm(F.col("a")), 6).alias("added_norm"), F.round(vectors.norm(F.col("r")), 6).alias("replaced_norm"), F.round(vectors.norm(vectors.difference(F.col("a"), F.col("v"))), 6).alias("delta_norm"))


@query(
    "q55_activation_diff",
    f"""
    with {_V}, p as (select a.vec_id, a.v as x, b.v as y from e a join e b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
    select vec_id, round(list_sum(x), 6) as sum_first, round(list_sum(y), 6) as sum_second, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] - y[i])), 6) as sum_diff from p""",
)
def activation_diff(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    second = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("y"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    pairs = e.where("vec_id % 2 = 0").join(second, "vec_id")
    return pairs.select("vec_id", total(F.col("v")).alias("sum_first"), total(F.col("y")).alias("sum_second"), total(vectors.difference(F.col("v"), F.col("y"))).alias("sum_diff"))


@query(
    "q56_probe_centroid",
    f"""
    with {_V}, x as (select vec_id, label, unnest(range(0, len(v))) as dim, unnest(v) as x from e),
    c as (select label, dim, avg(x) as m from x where vec_id % 5 <> 0 group by 1, 2),
    k as (select label, dense_rank() over (order by label) - 1 as class from (select distinct label from c)),
    s as (select x.vec_id, x.label as truth, c.label as guess, round(sum((x - m) * (x - m)), 9) as dist from x join c on c.dim = x.dim where x.vec_id % 5 = 0 group by 1, 2, 3),
    b as (select vec_id, truth, guess, row_number() over (partition by vec_id order by dist, guess) as r from s)
    select truth, k.class as class, count(*) as n, count(*) filter (where guess = truth) as correct, round(avg(case when guess = truth then 1.0 else 0.0 end), 6) as accuracy from b left join k on k.label = b.truth where r = 1 group by 1, 2""",
)
def probe_centroid(spark: SparkSession, d: str) -> DataFrame:
    """A linear probe by nearest centroid; labels become indices in sorted order. Points meet the centroids, one a label, in blocks."""
    e = embeddings(spark, d)
    x = e.where("vec_id % 5 <> 0").select("label", F.posexplode("v").alias("dim", "x"))
    means = x.groupBy(F.col("label").alias("guess"), "dim").agg(F.avg("x").alias("m"))
    c = means.groupBy("guess").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("v"))  # one entry a dimension
    classes = c.select(F.col("guess").alias("truth"), (F.dense_rank().over(Window.orderBy("guess")) - 1).alias("class"))
    test = e.where("vec_id % 5 = 0")
    best = nearest_centroid(test, c).join(test.select("vec_id", F.col("label").alias("truth")), "vec_id")
    hit = F.col("guess") == F.col("truth")
    return best.join(classes, "truth", "left").groupBy("truth", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@query(
    "q57_hard_negatives",
    f"""
    with {_V}, n as (select vec_id, label, v, {_NORM.format('v')} as n from e),
    s as (select a.vec_id, b.vec_id as neighbour, a.label as own, b.label as other, {_DOT.format('a.v', 'b.v')} / (a.n * b.n) as sim from n a, n b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by vec_id order by sim desc, neighbour) as rank from s),
    m as (select vec_id, max(sim) as top from r where rank <= 34 group by vec_id)
    select r.vec_id, neighbour, rank, round(sim, 6) as similarity from r join m on m.vec_id = r.vec_id where rank <= 34 and own <> other and sim > 0 and sim <= 0.75 * top""",
)
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Near rows of another label whose score stays below a share of the query's best."""
    rows = table(spark, d, "embeddings")
    near = cosine_top_k(rows.where("vec_id % 100 = 0"), rows, 34)
    label = rows.select("vec_id", "label")
    top = near.groupBy("vec_id").agg(F.max("similarity").alias("top"))
    judged = near.join(top, "vec_id").join(label.withColumnRenamed("label", "own"), "vec_id").join(label.toDF("neighbour", "other"), "neighbour")
    return judged.where((F.col("own") != F.col("other")) & (F.col("similarity") > 0) & (F.col("similarity") <= 0.75 * F.col("top"))).select("vec_id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@query(
    "q58_decode_reconstruct",
    f"""
    with {_V}, f as (select vec_id as feature, v as w from e where vec_id in (select vec_id from embeddings order by vec_id limit {FEATURES})),
    a as (select e.vec_id, f.feature, case when {_DOT.format('v', 'w')} > 0.05 then {_DOT.format('v', 'w')} else 0.0 end as act, w from e, f),
    x as (select vec_id, act, unnest(range(0, len(w))) as dim, unnest(w) as w from a)
    select vec_id, dim, round(sum(act * w) + 0.01, 6) as y from x group by 1, 2""",
)
def decode_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """f W + b: active features times their rows, summed by (row, dimension)."""
    e = embeddings(spark, d)
    dictionary = e.orderBy("vec_id").limit(FEATURES).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("f"))
    act = e.crossJoin(F.broadcast(dictionary)).select("vec_id", "f", F.transform("f", lambda w: vectors.threshold_relu(vectors.dot(F.col("v"), w), 0.05)).alias("act"))
    shares = F.zip_with("act", "f", lambda a, w: F.transform(w, lambda x: a * x))
    zeros = F.transform(F.get("f", F.lit(0)), lambda _: F.lit(0.0))
    y = F.aggregate(shares, zeros, lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    x = act.select("vec_id", F.posexplode(y).alias("dim", "y"))
    return x.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("y") + 0.01, 6).alias("y"))


@query(
    "q59_fill_missing",
    f"""
    with {_V}, d as (select vec_id, v, vec_id % 3 = 0 as missing from e)
    select vec_id, case when missing then 'provider' else 'stored' end as origin, round(case when missing then list_sum(v) * 2 else list_sum(v) end, 6) as total from d""",
)
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Only rows without a stored vector go to the provider; the rest is coalesced."""
    e = embeddings(spark, d)
    stored = e.withColumn("stored", F.when(F.col("vec_id") % 3 != 0, F.col("v"))).drop("v", "label")
    provided = stored.where("stored is null").select("vec_id").join(e.select("vec_id", "v"), "vec_id").select("vec_id", F.transform("v", lambda x: x * 2).alias("provided"))
    both = stored.join(provided, "vec_id", "left")
    total = F.aggregate(F.coalesce("stored", "provided"), F.lit(0.0), lambda s, x: s + x)
    return both.select("vec_id", F.when(F.col("stored").isNull(), "provider").otherwise("stored").alias("origin"), F.round(total, 6).alias("total"))


@query(
    "q69_precision_recall_f1",
    """
    with p as (select label, list(vec_id order by vec_id) as truth from embeddings group by label),
    q as (select label, truth, list_filter(truth, lambda x: x % 3 <> 0) || list_transform(list_filter(truth, lambda x: x % 5 = 0), lambda x: x + 100000) as pred from p),
    m as (select label, len(pred) as n_pred, len(truth) as n_true, len(list_intersect(pred, truth)) as hits from q)
    select label, round(case when n_pred > 0 then hits / n_pred else 0.0 end, 6) as precision, round(case when n_true > 0 then hits / n_true else 0.0 end, 6) as recall,
      round(case when hits > 0 then 2.0 * hits / (n_pred + n_true) else 0.0 end, 6) as f1, hits > 0 and 2.0 * hits / (n_pred + n_true) > 0.75 as kept from m""",
)
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Scores of index sets by label, safe for empty sets. The sets stay rows: a label's set never has to fit one task."""
    truth = table(spark, d, "embeddings").select("label", "vec_id").distinct()
    shifted = truth.where("vec_id % 5 = 0").select("label", F.col("vec_id") + 100000)
    predicted = truth.where("vec_id % 3 <> 0").union(shifted)
    return evals.set_scores(predicted, truth, ["label"], "vec_id").select("label", "precision", "recall", "f1", (F.col("f1") > 0.75).alias("kept"))


@query(
    "q80_random_baseline",
    f"""
    with r as (select vec_id, label, row_number() over (order by {key('vec_id', 'baseline')}, vec_id) as ord, count(*) over () as n from embeddings)
    select a.label, count(*) as n, count(*) filter (where a.label = b.label) as same from r a join r b on b.ord = case when a.ord = a.n then 1 else a.ord + 1 end group by a.label""",
)
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Labels dealt on by one place of a shuffle: how often a random explanation fits."""
    pairs = joins.reassigned(table(spark, d, "embeddings"), "vec_id", "label", salt="baseline")
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("other_value")).alias("same"))


TEST_SENTENCES, TRAIN_SENTENCES = 5, 10


@query(
    "q82_detection_split",
    f"""
    with r as (select vec_id, label, row_number() over (partition by label order by {key('vec_id', 'detect')}, vec_id) as ord, count(*) over (partition by label) as n from embeddings),
    k as (select *, case when ord <= {TEST_SENTENCES} then 'test' when ord <= {TEST_SENTENCES + TRAIN_SENTENCES} then 'train' end as part from r where n >= {TEST_SENTENCES + TRAIN_SENTENCES}),
    m as (select label, vec_id, row_number() over (partition by label order by {key('vec_id', 'mix')}, vec_id) - 1 as slot, vec_id % 2 = 0 as is_target from k where part = 'test')
    select label, array_to_string(list(slot order by slot) filter (where is_target), ',') as targets, count(*) as n_test, (select count(*) from k where k.label = m.label and part = 'train') as n_train from m group by label""",
)
def detection_split(spark: SparkSession, d: str) -> DataFrame:
    """Test and train sentences of each feature that has enough, the test ones shuffled with their targets' places."""
    from weftline.ranks import shuffled_rank

    rows = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TEST_SENTENCES + TRAIN_SENTENCES)
    ranked = shuffled_rank(rows.join(sizes, "label"), "vec_id", "detect", ["label"], rank="ord")
    test = ranked.where(F.col("ord") <= TEST_SENTENCES)
    n_train = ranked.where((F.col("ord") > TEST_SENTENCES) & (F.col("ord") <= TEST_SENTENCES + TRAIN_SENTENCES)).groupBy("label").agg(F.count(F.lit(1)).alias("n_train"))
    mixed = test.withColumn("slot", F.row_number().over(Window.partitionBy("label").orderBy(md5_key("vec_id", "mix"), "vec_id")) - 1)
    targets = F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == 0, F.col("slot"))))
    out = mixed.groupBy("label").agg(targets.alias("t"), F.count(F.lit(1)).alias("n_test")).join(n_train, "label")
    return out.select("label", F.when(F.size("t") > 0, F.array_join(F.col("t").cast("array<string>"), ",")).alias("targets"), "n_test", "n_train")


