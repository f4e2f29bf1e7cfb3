"""Scoring of responses and the tables made of the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.ranks import medians


def score_table(df: DataFrame, group: Sequence[str], hit: Column, digits: int = 6) -> DataFrame:
    """Per group: n, correct, accuracy, se, lo, hi. Partial counts leave every partition; a null hit is a miss."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if(F.coalesce(hit, F.lit(False))), F.lit(0)).alias("correct"))
    p = stats.share(F.col("correct"), F.col("n"))
    r = lambda c: F.round(c, digits)
    return counted.select(
        *group, "n", "correct", r(p).alias("accuracy"), r(stats.binomial_error(p, F.col("n"))).alias("se"),
        r(stats.binomial_low(p, F.col("n"))).alias("lo"), r(stats.binomial_high(p, F.col("n"))).alias("hi"),
    )


def two_level_means(df: DataFrame, outer: str, inner: str, value: str, digits: int = 6) -> DataFrame:
    """Mean, margin and count by (outer, inner) and by outer alone (inner null), in one pass."""
    sets = [[F.col(outer), F.col(inner)], [F.col(outer)]]
    grouped = df.groupingSets(sets, outer, inner).agg(
        F.round(F.avg(value), digits).alias("mean"), F.round(stats.mean_margin(F.col(value)), digits).alias("margin"), F.count(value).alias("n"), F.grouping(inner).cast("int").alias("is_total")
    )
    return grouped


def micro_macro(df: DataFrame, group: str, hit: Column, digits: int = 6) -> DataFrame:
    """One row: micro accuracy, macro accuracy, deviation over groups (population), count-weighted mean, groups."""
    by = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("acc"))
    r = lambda c: F.round(c, digits)
    weighted = F.sum(F.col("acc") * F.col("n")) / F.sum("n")
    return by.agg(r(weighted).alias("micro"), r(F.avg("acc")).alias("macro"), r(F.stddev_pop("acc")).alias("macro_std"), r(weighted).alias("weighted"), F.count(F.lit(1)).alias("n_groups"))


def best_of(df: DataFrame, group: Sequence[str], score: str, item: str) -> DataFrame:
    """The highest score of each group and the first item that has it."""
    return df.groupBy(*group).agg(F.max(score).alias("best"), F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("best_item"), F.count(F.lit(1)).alias("n"))


def aggregate_as(df: DataFrame, group: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """max, min, median, mean and population deviation side by side. Medians come from ranges of values, so no group is held or sorted in one task."""
    r = lambda c, n: F.round(c, digits).alias(n)
    spread = df.groupBy(*group).agg(r(F.max(value), "max"), r(F.min(value), "min"), r(F.avg(value), "mean"), r(F.stddev_pop(value), "std_pop"), F.count(value).alias("n"))
    middle = medians(df, value, group)
    names = [F.col(g).alias(f"_m{i}") for i, g in enumerate(group)]
    same = [F.col(g).eqNullSafe(F.col(f"_m{i}")) for i, g in enumerate(group)]
    joined = spread.join(middle.select(*names, "median"), same, "left")
    return joined.select(*group, "max", "min", r(F.col("median"), "median"), "mean", "std_pop", "n")


def merged_counts(frames: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """(correct, n) partials of several files added up."""
    from weftline.operators.joins import union_all

    return union_all(*frames).groupBy(*group).agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))


def set_scores(predicted: DataFrame, truth: DataFrame, group: Sequence[str], item: str, digits: int = 6) -> DataFrame:
    """Precision, recall and F1 of sets given as rows (group, item), by one join; 0 for empty sets."""
    a = predicted.select(*group, item).distinct().withColumn("_p", F.lit(1))
    b = truth.select(*group, item).distinct().withColumn("_t", F.lit(1))
    counted = a.join(b, [*group, item], "full").groupBy(*group).agg(F.count("_p").alias("n_predicted"), F.count("_t").alias("n_true"), F.count(F.col("_p") + F.col("_t")).alias("hits"))
    p, r = stats.share(F.col("hits"), F.col("n_predicted")), stats.share(F.col("hits"), F.col("n_true"))
    scored = counted.withColumn("_precision", p).withColumn("_recall", r)
    f = stats.f1(F.col("_precision"), F.col("_recall"))
    return scored.select(*group, "n_predicted", "n_true", "hits", F.round("_precision", digits).alias("precision"), F.round("_recall", digits).alias("recall"), F.round(f, digits).alias("f1"))
