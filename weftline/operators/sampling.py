"""Seeded choices: paraphrases, wrong answers, fractions of an id space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.rand import choose, md5_below, md5_key
from weftline.ranks import shuffled_rank


def other_than(options: Column, right: Column, key: Column | str, salt: str) -> Column:
    """One of the sorted options that isn't ``right``; null if there is none."""
    return choose(F.filter(options, lambda o: o != right), key, salt)


def some_of(options: Column, n: int, key: Column | str, salt: str) -> Column:
    """``n`` different elements of an array, by the order of their hashes with the key; all if there are fewer."""
    k = F.col(key) if isinstance(key, str) else key
    ranked = F.array_sort(F.transform(options, lambda o: F.struct(md5_key(F.concat_ws("#", k.cast("string"), o), salt).alias("h"), o.alias("o"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["o"])


def right_or_wrong(options: Column, right: Column, key: Column | str, salt: str) -> Column:
    """Struct (shown, answer): the right label with Yes or another with No, half and half; a label without others is always shown."""
    wrong = other_than(options, right, key, salt + ".other")
    lie = (md5_below(key, salt + ".coin", 2) == 1) & wrong.isNotNull()
    return F.struct(F.when(lie, wrong).otherwise(right).alias("shown"), F.when(lie, "No").otherwise("Yes").alias("answer"))


def fraction(df: DataFrame, key: str, share: float, *, salt: str) -> DataFrame:
    """``max(1, floor(n * share))`` rows, the first of a shuffle."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(df, key, salt, rank="_at").crossJoin(F.broadcast(total))
    return ranked.where(F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_at", "_n")


def with_replacement(df: DataFrame, key: str, n: Column | int, total: str, *, salt: str, group: list[str]) -> DataFrame:
    """Ordinals 0..n-1 with a row drawn for each, per group; the row's rank in a shuffle is ``hash mod total``."""
    draws = df.select(*group, total).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n).cast("int") - 1)))
    place = md5_below(F.concat_ws("#", *group, F.col("draw")), salt, F.greatest(F.col(total), F.lit(1))) + 1
    ranked = shuffled_rank(df.drop(total), key, salt, group, rank="_at")
    return draws.withColumn("_at", place).drop(total).join(ranked, [*group, "_at"]).drop("_at")
