"""Hand-computed rows for the semantic traps."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import sequences as seq
from weftline.functions import stats, text, vectors
from weftline.operators import cache, evals, joins, order, sampling
from weftline.operators.neighbours import cosine_top_k
from weftline.ranks import floor_quantile, hashed_rank, lower_median, upper_median, value_at_rank, value_rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(("said", "normal"), [("Yes.", "yes"), ("Yes. ", "yes."), (" NO!?", "no"), ("", ""), (None, None)])
def test_punctuation_goes_before_blanks(spark, said, normal):
    assert one(spark, text.normalise_answer(F.lit(said).cast("string"))) == normal


def test_containment_is_not_exclusive(spark):
    assert one(spark, text.contains_answer(F.lit("I know"), F.lit("no"))) is True
    assert one(spark, text.contains_exclusively(F.lit("yes and no"), F.lit("yes"), F.lit("no"))) is False
    assert one(spark, text.contains_any(F.lit("Yeah"), F.array(F.lit("yes"), F.lit("yeah")))) is True


def test_whole_words_only(spark):
    say = lambda s: one(spark, text.word_class(F.lit(s), "male", "female"))
    assert [say(s) for s in ("a male", "females", "male, female", "maleness")] == ["male", "female", "both", "neither"]


@pytest.mark.parametrize("lo", [-9, -3, -1, 0, 1, 2, 9])
@pytest.mark.parametrize("hi", [-9, -1, 0, 2, 3, 9])
def test_slices_are_as_lenient_as_lists(spark, lo, hi):
    items = [1, 2, 3]
    array = F.array(*map(F.lit, items))
    assert one(spark, seq.py_slice(array, lo, hi)) == items[lo:hi]


def test_window_is_cut_and_may_be_empty(spark):
    assert one(spark, seq.end_window(F.lit(5), -1, 3)) == [2, 3, 4]
    assert one(spark, seq.end_window(F.lit(2), -1, 9)) == [0, 1]
    assert one(spark, seq.end_window(F.lit(2), -3, 9)) == []
    assert one(spark, seq.clamp_end(F.lit(0), F.lit(9))) == 1


def test_markers_and_runs(spark):
    a = F.array(*[F.lit(x) for x in ["?", "a", "?", "?"]])
    assert one(spark, seq.marker_positions(a, "?", 2)) == [0, 2]
    assert one(spark, seq.is_run(F.array(F.lit(2), F.lit(3)))) is True
    assert one(spark, seq.is_run(F.array(F.lit(0), F.lit(2)))) is False
    assert one(spark, seq.is_run(F.array().cast("array<int>"))) is False


def test_padding_is_undone(spark):
    ids = F.array(F.lit(0), F.lit(7))
    assert one(spark, seq.left_pad(ids, F.lit(4))) == [0, 0, 0, 7]
    assert one(spark, seq.unpad(seq.left_pad(ids, F.lit(4)), seq.pad_mask(ids, F.lit(4)))) == [0, 7]
    assert one(spark, seq.loss_labels(ids, 1)) == [-100, 7]
    assert one(spark, seq.masks_once(F.array(F.lit(-100), F.lit(1)))) is True
    assert one(spark, seq.masks_once(F.array(F.lit(1), F.lit(-100)))) is False


def test_tags_need_four_with_two_of_each(spark):
    good = "".join(f"<question>{i}</question><answer>{a}</answer>" for i, a in enumerate(["Yes", " no", "YES", "No "]))
    assert [r["answer"] for r in one(spark, text.tagged_pairs(F.lit(good)))] == ["yes", "no", "yes", "no"]
    assert one(spark, text.tagged_pairs(F.lit(good.replace("YES", "no")))) is None
    assert one(spark, text.after_last_open_tag(F.lit("a<x>b</x><x>c</x>"), "x")) == "c"
    assert one(spark, text.after_last_open_tag(F.lit("a"), "x")) == "a"
    assert one(spark, text.fenced_json(F.lit("x\n```json\n[1]\n```\ny"))) == "[1]"
    assert one(spark, text.fenced_json(F.lit("x\n\n[2]"))) == "[2]"


def test_names(spark):
    assert one(spark, text.learning_rate(F.lit("a_lr_3e-6_b"))) == 3e-6
    assert one(spark, text.learning_rate(F.lit("a"))) == 1e-5
    assert one(spark, text.run_index(F.lit("x__run12"))) == 12
    assert one(spark, text.run_index(F.lit("x_run12_y"))) is None
    assert one(spark, text.last_segment(F.lit(None).cast("string"))) == "base_model"
    assert one(spark, text.stem(F.lit("a/b.jpg#3"))) == "b"
    assert one(spark, text.decapitalise(F.lit("The end."))) == "the end"
    assert one(spark, text.decapitalise(F.lit(""))) == ""


def test_three_medians_and_quantile(spark):
    df = spark.createDataFrame([(x,) for x in [4, 1, 3, 2]], "v int")
    at = lambda place: value_at_rank(df, "v", place).collect()[0]["value"]
    assert (at(upper_median()), at(lower_median()), at(floor_quantile(0.9))) == (3, 2, 3)


def test_intervals_at_the_edges(spark):
    assert one(spark, stats.binomial_low(F.lit(0.0), F.lit(0))) == 0
    assert one(spark, stats.binomial_high(F.lit(1.0), F.lit(4))) == 1
    assert one(spark, stats.f1(F.lit(0.0), F.lit(0.0))) == 0
    empty = F.array().cast("array<int>")
    assert one(spark, stats.precision(empty, F.array(F.lit(1)))) == 0


def test_single_value_has_no_margin(spark):
    rows = evals.two_level_means(spark.createDataFrame([("a", "x", 1.0)], "o string, i string, v double"), "o", "i", "v").collect()
    assert {r["margin"] for r in rows} == {None}


def test_steering_adds_or_replaces(spark):
    v, d = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, vectors.steer_add(v, d, 1.0)) == [3.0, 9.0]
    assert one(spark, vectors.steer_replace(v, d, 1.0)) == [0.0, 5.0]
    assert one(spark, vectors.threshold_relu(F.lit(0.1), 0.2)) == 0


def test_ranks_are_a_permutation_whatever_the_skew(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', cast(id % 3 as string)) as g", "id % 2 as same")
    ranked = hashed_rank(df, ["g"], "id", 1).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(1, len(r["r"]) + 1)) for r in ranked)
    tied = value_rank(df, "same", "id", ["g"], descending=True).where("g = 'hot'").orderBy("rank").select("same", "id").collect()
    assert [tuple(r) for r in tied] == sorted(((i % 2, i) for i in range(900)), key=lambda x: (-x[0], x[1]))


def test_rank_keeps_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 2, None), (None, 3, 1)], "g string, id int, n int")
    assert sorted((r["id"], r["rank"]) for r in value_rank(df, "n", "id", ["g"]).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_splits_are_disjoint_and_zero_means_none(spark):
    df = spark.range(10)
    split = order.head_tail_split(df, "id", train=100, test=0, salt="s").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 10}
    split = order.head_tail_split(df, "id", train=100, test=4, salt="s").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 6, "test": 4}


def test_shards_make_up_the_whole(spark):
    dealt = order.strided_shards(spark.range(100), "id", 4, 5, salt="s").groupBy("shard").count().collect()
    assert {r["count"] for r in dealt} == {25}


def test_interleave_can_keep_the_rest(spark):
    a, b = spark.range(5), spark.range(1)
    whole = order.interleave(a, b, "id", 2, 1)
    assert sorted((r["pos"], r["source"]) for r in whole.collect()) == [(0, "left"), (1, "left"), (2, "right")]
    assert order.interleave(a, b, "id", 2, 1, partial=True).count() == 6


def test_packing_keeps_the_last_open_pack(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([2, 2, 5, 1])], "s string, id int, n int")
    packed = order.pack_greedily(df, "s", "id", F.col("n"), 4).orderBy("id").collect()
    assert [r["pack_id"] for r in packed] == [0, 0, 1, 2]


def test_other_label_is_never_the_right_one(spark):
    df = spark.range(200).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("o"))
    drawn = df.select(sampling.other_than(F.col("o"), F.lit("b"), "id", "x").alias("x")).distinct().collect()
    assert {r["x"] for r in drawn} == {"a", "c"}
    assert one(spark, sampling.other_than(F.array(F.lit("b")), F.lit("b"), F.lit(1), "x")) is None
    assert len(one(spark, sampling.some_of(F.array(F.lit("a"), F.lit("b")), 5, F.lit(1), "x"))) == 2


def test_draws_with_replacement(spark):
    df = spark.createDataFrame([(i, "g", 3) for i in range(3)], "id int, g string, n int")
    rows = sampling.with_replacement(df, "id", 10, "n", salt="x", group=["g"]).collect()
    assert len(rows) == 10
    assert {r["id"] for r in rows} <= {0, 1, 2}


def test_lookup_takes_the_first_and_shows_the_missing(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 3)], "k int, v int")
    assert [tuple(r) for r in joins.lookup(left, right, "k", "v").collect()] == [(1, 3)]
    assert [r["k"] for r in joins.missing_keys(left, right, "k").collect()] == [2]


def test_cache_asks_once_and_keeps_null_hits(spark):
    requests = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "p string")
    key = lambda p: one(spark, text.request_key(F.lit(p)))
    earlier = spark.createDataFrame([(key("b"), None, 2), (key("b"), "old", 1)], "key string, response string, seq int")
    answers, new = cache.cached(requests, earlier, "p", lambda s: s + "!")
    got = sorted((r["p"], r["response"], r["hit"]) for r in answers.where("p <> 'b'").collect())
    assert got == [("a", "a!", False), ("a", "a!", False), ("c", "c!", False)]
    assert [(r["response"], r["hit"]) for r in answers.where("p = 'b'").collect()] == [(None, True)]
    assert new.count() == 2


def test_neighbours_skip_null_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r)[:3] for r in cosine_top_k(df, df, 2, block=2).where("vec_id = 1").orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 6, 2)]
    assert cosine_top_k(df.limit(0), df, 2).count() == 0


def test_full_unicode_folding(spark):
    from weftline.functions.unicode import fold_unicode

    got = [r["x"] for r in spark.createDataFrame([("Țuică, ﬁne—Smørrebrød",), (None,), ("",)], "t string").select(fold_unicode(F.col("t")).alias("x")).collect()]
    assert got == ["tuica fine smørrebrød", None, ""]
