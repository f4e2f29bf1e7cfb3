"""Joins with the contracts of lookups, zips and set tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.ranks import value_rank


def lookup(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Inner join with the first row (by ``order``) of each key on the right, so rows never multiply."""
    first = right.groupBy(on).agg(F.min_by(F.struct(*[c for c in right.columns if c != on]), order).alias("_r")).select(on, "_r.*")
    return left.join(first, on)


def missing_keys(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys of the left that the right lacks; a lookup is complete if this is empty."""
    return left.select(on).distinct().join(right.select(on), on, "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Positional join by the order of the keys. The column ``same_length`` is false if the sides differ in length."""
    a = value_rank(left, left_key, left_key, rank="_at")
    b = value_rank(right, right_key, right_key, rank="_at")
    return a.join(b, "_at", "full").withColumn("same_length", F.col(left_key).isNotNull() & F.col(right_key).isNotNull()).drop("_at")


def round_robin(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Each left row with the right row of ordinal ``i mod n``. The right side is small: it is dealt out by its own count."""
    a = value_rank(left, left_key, left_key, rank="_i")
    b = value_rank(right, right_key, right_key, rank="_j").crossJoin(F.broadcast(right.agg(F.count(F.lit(1)).alias("_n"))))
    n = right.agg(F.count(F.lit(1)).alias("_m"))
    return a.crossJoin(F.broadcast(n)).withColumn("_j", F.pmod(F.col("_i") - 1, F.col("_m")) + 1).join(b.drop("_n"), "_j").drop("_i", "_j", "_m")


def first_candidate(df: DataFrame, candidates: list[Column], existing: DataFrame, name: str) -> DataFrame:
    """The first of several candidate names that exists; rows without any are dropped."""
    rows = df.withColumn("_c", F.arrays_zip(F.sequence(F.lit(0), F.lit(len(candidates) - 1)).alias("rank"), F.array(*candidates).alias("name")))
    exploded = rows.select(*df.columns, F.explode("_c").alias("_c")).select(*df.columns, F.col("_c.rank").alias("_rank"), F.col("_c.name").alias(name))
    found = exploded.join(existing.select(name).distinct(), name, "left_semi")
    return found.groupBy(*df.columns).agg(F.min_by(name, "_rank").alias(name))


def route(df: DataFrame, text: str, routes: list[tuple[str, str]], name: str) -> DataFrame:
    """The target of the first route whose pattern the text contains; null without one."""
    return df.withColumn(name, F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(p)), F.lit(t)) for p, t in routes]))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reassigned(df: DataFrame, key: str, value: str, *, salt: str) -> DataFrame:
    """Each row with the value of the next row of a shuffle (the last with the first's): a baseline that pairs rows at random.

    Columns: key, value, other_key, other_value. A single row is paired with itself.
    """
    from weftline.ranks import shuffled_rank

    ranked = shuffled_rank(df.select(key, value), key, salt, rank="_at").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    other = ranked.select(F.col(key).alias("other_key"), F.col(value).alias("other_value"), F.when(F.col("_at") == 1, F.col("_n")).otherwise(F.col("_at") - 1).alias("_at"))
    return ranked.drop("_n").join(other, "_at").drop("_at")


def distinct_by(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row (by ``order``) of each value, without a window: partial minima leave every partition."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(by, "_r.*").select(*df.columns)


def names_once(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name no other row has; names are counted before any other filter. Partial counts leave every partition, so a frequent name is never in one task."""
    counted = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in df.columns if c != name])).alias("_r"))
    return counted.where("_n = 1").select(name, "_r.*").select(*df.columns)


def aligned(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str) -> DataFrame:
    """One row: rows on each side, rows at the same place (by ``order``) and how many of them have other keys than their partner.

    The sides are aligned if n_left = n_right and n_other = 0; :func:`checked` makes that an error.
    """
    a = value_rank(left.select(F.col(order).alias("_o"), F.col(left_key).alias("_l")), "_o", "_o", rank="_at").select("_at", "_l", F.lit(1).alias("_a"))
    b = value_rank(right.select(F.col(order).alias("_o"), F.col(right_key).alias("_r")), "_o", "_o", rank="_at").select("_at", "_r", F.lit(1).alias("_b"))
    both = a.join(b, "_at", "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(met).alias("n_met"), F.count_if(met & ~F.col("_l").eqNullSafe(F.col("_r"))).alias("n_other"))


def checked(report: DataFrame) -> DataFrame:
    """The report of :func:`aligned`; running it is an error if the sides aren't aligned."""
    fine = (F.col("n_left") == F.col("n_right")) & (F.col("n_other") == 0)
    return report.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("keys differ at "), F.col("n_other"), F.lit(" places of "), F.col("n_left")))))
