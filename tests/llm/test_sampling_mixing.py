"""Problems 1 and 2 against brute force, and on dirty input."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm.mixing import mix_sources
from weftline.llm.sampling import proportional_sample

POOL = "pool string, record_id bigint, ds_label string"
TARGETS = "target_set int, pool string, category string, target_share double, sample_size bigint, min_count int"
RECORDS = "point_id bigint, datapoint_type string, n_tokens int"
MIX = "mix_id int, dataset_name string, target_share double, total_records bigint, max_repeats int"
CONFIGS = "dataset_name string, num_train int, updated_at timestamp"


def test_quotas_floors_and_shortfalls(spark):
    random.seed(0)
    rows = [("p", i, random.choice(["Cat", "cat ", "CAT."])) for i in range(700)] + [("p", 1000 + i, "dog") for i in range(40)] + [("p", 2000 + i, "emu") for i in range(2)]
    pool = spark.createDataFrame(rows + rows[:50], POOL).withColumn("rank", F.lit("clash")).withColumn("category", F.lit("clash"))
    targets = spark.createDataFrame([(1, "p", "cat", 0.5, 61, 3), (1, "p", "dog", 0.01, 61, 5), (1, "p", "emu", 0.49, 61, 3), (2, "p", "fox", 1.0, 5, 0), (3, "q", "cat", 1.0, 5, 1)], TARGETS)
    sample, report = proportional_sample(pool, targets)
    got = {(r["target_set"], r["category"]): (r["wanted"], r["available"], r["drawn"], r["shortfall"]) for r in report.collect()}
    assert got == {(1, "cat"): (31, 700, 31, 0), (1, "dog"): (5, 40, 5, 0), (1, "emu"): (30, 2, 2, 28), (2, "fox"): (5, 0, 0, 5), (3, "cat"): (5, 0, 0, 5)}
    drawn = sample.collect()
    assert len({(r["target_set"], r["record_id"]) for r in drawn}) == len(drawn) == 38
    assert {(r["set_total"], r["sample_size"], r["reached_share"]) for r in report.where("category = 'cat' and target_set = 1").collect()} == {(38, 61, round(31 / 38, 9))}
    assert sum(r["drawn_by"] == "floor" for r in drawn) == 4
    again = sorted(map(repr, proportional_sample(pool.repartition(3), targets)[0].collect()))
    assert again == sorted(map(repr, drawn))


def test_systematic_draw_is_spread_over_the_hash_order(spark):
    pool = spark.range(2000).select(F.lit("p").alias("pool"), F.col("id").alias("record_id"), F.lit("a").alias("ds_label"))
    sample, _ = proportional_sample(pool, spark.createDataFrame([(1, "p", "a", 1.0, 500, 0)], TARGETS))
    ids = [r["record_id"] for r in sample.collect()]
    assert len(ids) == 500
    assert abs(sum(ids) / 500 - 1000) < 100


def test_nulls_and_empty_tables(spark):
    pool = spark.createDataFrame([("p", None, "a"), ("p", 1, None), ("p", 2, " "), (None, 3, "a")], POOL)
    targets = spark.createDataFrame([(1, "p", "a", None, None, None), (1, "p", None, 0.5, 10, 1), (1, "p", "--", 0.5, 10, 1)], TARGETS)
    sample, report = proportional_sample(pool, targets)
    assert sample.count() == 0
    assert {(r["category"], r["wanted"], r["drawn"]) for r in report.collect()} == {("a", 0, 0), (None, 5, 0), ("--", 5, 0)}
    sample, report = proportional_sample(pool.limit(0), targets.limit(0))
    assert sample.count() == report.count() == 0


def test_mix_meets_its_shares(spark):
    rows = [(i, " Big-Set" if i % 2 else "big_set", i % 7) for i in range(900)] + [(2000 + i, "small", 5) for i in range(10)]
    records = spark.createDataFrame(rows + rows[:100], RECORDS).withColumn("rank", F.lit(1)).withColumn("wanted", F.lit(1))
    targets = spark.createDataFrame([(1, "BIG_SET", 0.8, 100, 1), (1, "small", 0.2, 100, 3), (2, "big_set", 0.9, 1000, 2), (2, "small", 0.1, 1000, 4), (2, "none", 0.5, 10, 1)], MIX)
    configs = spark.createDataFrame([("big_set", 300, None), ("Small", 8, None)], CONFIGS)
    mix, report = mix_sources(records, targets, configs)
    rows = {(r["mix_id"], r["dataset_name"]): r for r in report.collect()}
    got = {k: (r["wanted"], r["usable"], r["capacity"], r["expected"]) for k, r in rows.items()}
    assert got == {(1, "BIG_SET"): (80, 300, 300, 80), (1, "small"): (20, 8, 24, 20), (2, "big_set"): (900, 300, 600, 600), (2, "small"): (100, 8, 32, 32), (2, "none"): (5, 0, 0, 0)}
    assert [rows[k]["drawn"] for k in ((2, "big_set"), (2, "small"), (2, "none"))] == [600, 32, 0]  # whole rates leave nothing to chance
    assert abs(rows[1, "BIG_SET"]["drawn"] - 80) < 4 * (300 * 80 / 300 * 220 / 300) ** 0.5
    assert 16 <= rows[1, "small"]["drawn"] <= 24
    assert all(r["deviation"] == pytest.approx(r["share"] - r["target_share"]) for r in rows.values())
    used = mix.collect()
    assert len({(r["mix_id"], r["dataset_name"], r["record_id"]) for r in used}) == len(used)
    assert {r["copies"] for r in used if r["dataset_name"] == "small" and r["mix_id"] == 1} <= {2, 3}
    again = mix_sources(records.repartition(5), targets, configs)[0].collect()
    assert sorted(map(repr, again)) == sorted(map(repr, used))
    assert all(r["copies"] <= 4 for r in used)
    shares = report.where("mix_id = 1").agg(F.sum("share")).collect()[0][0]
    assert shares == pytest.approx(1)


def test_token_mix_is_near_its_target(spark):
    records = spark.range(5000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("datapoint_type"), (F.col("id") % 50).cast("int").alias("n_tokens"))
    targets = spark.createDataFrame([(1, "a", 0.5, 60000, 9), (1, "b", 0.5, 60000, 9)], MIX)
    report = mix_sources(records, targets, spark.createDataFrame([], CONFIGS), size="n_tokens")[1].collect()
    assert all(r["size_drawn"] == pytest.approx(30000, rel=0.1) for r in report)


def test_mix_without_records(spark):
    targets = spark.createDataFrame([(1, "a", None, 10, 1), (1, None, 0.5, 10, None)], MIX)
    mix, report = mix_sources(spark.createDataFrame([(None, "a", 1), (1, None, 1)], RECORDS), targets, spark.createDataFrame([(None, 3, None)], CONFIGS))
    assert mix.count() == 0
    assert {r["drawn"] for r in report.collect()} == {0}


def test_sums_beyond_64_bits_do_not_overflow(spark):
    """rank x quota of three thousand million rows each, by the operator's own arithmetic on one row."""
    wide = lambda n: F.lit(n).cast("decimal(19,0)")
    n = 6_000_000_000
    assert spark.range(1).select(F.call_function("div", wide(n) * wide(n) + wide(7), wide(n))).collect()[0][0] == n
