"""Exact ranks inside groups of any size, without gathering a group in one task.

A plain ``row_number() over (partition by g)`` sends a whole group to one task. Here the order
key is cut into buckets whose row counts are added up first (a prefix sum over a table of at most
groups x buckets rows); each row then needs only its rank inside its own small bucket. The number of
buckets follows the bytes that the plan reads, so a bucket stays small whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of input for each bucket, and the least and the most buckets for each group.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 256, 1 << 22


def buckets_for(df: DataFrame, least: int = LEAST_BUCKETS) -> int:
    """A power of two from the size of the tables that a plan reads, as the optimizer estimates it; no job is run. Ranks don't depend on it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(min(abs(int(leaves.apply(i).stats().sizeInBytes())), 1 << 60) for i in range(leaves.size()))
    return min(max(least, 1 << (read // BUCKET_BYTES).bit_length()), MOST_BUCKETS)


def hashed_rank(df: DataFrame, group: Sequence[str], tie: str | Sequence[str], seed: int, *, rank: str = "rank", buckets: int | None = None) -> DataFrame:
    """Add ``rank`` (1, 2, ...): the place of each row in a random but fixed order of its group.

    The order is by a 64-bit hash of ``tie`` (a column or several) and the group, then by ``tie``, so it doesn't depend
    on how rows are partitioned. Rows equal in group and ``tie`` keep distinct ranks in no fixed order.
    ``buckets`` must be a power of two; by default it follows the size of the input.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    bits = (buckets or buckets_for(df)).bit_length() - 1
    h = F.xxhash64(*[F.col(t) for t in ties], *[F.col(g) for g in group], F.lit(seed))
    keyed = df.withColumn("_h", h)
    return bucketed_rank(keyed, group, F.shiftrightunsigned(F.col("_h"), 64 - bits), [F.col("_h"), *[F.col(t) for t in ties]], rank=rank).drop("_h")


def shuffled_rank(df: DataFrame, key: str, salt: str, group: Sequence[str] = (), *, rank: str = "rank") -> DataFrame:
    """The same in the order of ``md5(key|salt)``, which SQL can state; 4096 buckets or more."""
    from weftline.rand import md5_key

    digits = max(3, -(-(buckets_for(df).bit_length() - 1) // 4))
    keyed = df.withColumn("_m", md5_key(key, salt))
    return bucketed_rank(keyed, group, F.substring("_m", 1, digits), [F.col("_m"), F.col(key)], rank=rank).drop("_m")


#: Values are cut into COARSE x COARSE ranges between approximate quantiles, and each of these into FINE parts of one width.
COARSE, FINE = 16, 64


def value_ranges(df: DataFrame, value: str, name: str = "_range") -> DataFrame:
    """Add ``name``, a whole number that never falls as ``value`` rises: the value's place among approximate quantiles, and between two of them.

    However the values are spread, the ranges between quantiles hold about as many rows each; only rows with one value share a part
    whatever their number. The quantiles are one row, found by partial aggregation.
    """
    n = COARSE * COARSE
    v = F.col(value).cast("double")
    sample = F.percentile_approx(v, [i / n for i in range(n + 1)], 16 * n)
    bounds = df.agg(sample.alias("_q")).select(F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: F.slice("_q", i * COARSE + 1, COARSE + 1)).alias("_q"))
    at = F.greatest(F.size(F.filter("_q", lambda q: F.get(q, F.lit(0)) <= v)) - 1, F.lit(0))
    inside = lambda q: F.greatest(F.size(F.filter(F.slice(q, 1, COARSE), lambda x: x <= v)) - 1, F.lit(0))
    joined = df.crossJoin(F.broadcast(bounds)).withColumn("_c", at).withColumn("_q", F.get("_q", F.col("_c"))).withColumn("_f", inside(F.col("_q")))
    low, high = F.get("_q", F.col("_f")), F.get("_q", F.col("_f") + 1)
    part = F.when(high > low, F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor((v - low) / (high - low) * FINE).cast("int")))).otherwise(0)
    return joined.withColumn(name, (F.col("_c") * COARSE + F.col("_f")) * FINE + part).drop("_q", "_c", "_f")


def value_rank(df: DataFrame, value: str, tie: str, group: Sequence[str] = (), *, descending: bool = False, rank: str = "rank") -> DataFrame:
    """The rank by ``value``, a number, then by ``tie``; nulls come last.

    Rows are cut into ranges of values that hold about as many rows each (see :func:`value_ranges`), so one outlier or a long
    tail doesn't gather them in one task.
    """
    v = F.col(value)
    order = [v.desc_nulls_last() if descending else v.asc_nulls_last(), F.col(tie)]
    ranged = value_ranges(df, value)
    part = F.when(v.isNull(), COARSE * COARSE * FINE).otherwise(-F.col("_range") if descending else F.col("_range"))
    return bucketed_rank(ranged, group, part, order, rank=rank).drop("_range")


def bucketed_rank(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], *, rank: str = "rank") -> DataFrame:
    """The rank by ``order``; ``bucket`` must never fall along that order."""
    keyed = df.withColumn("_b", bucket)
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_o{i}" for i in range(len(group) + 1)]
    offsets = counts.select(*[F.col(c).alias(n) for c, n in zip((*group, "_b"), names, strict=True)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    matched = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((*group, "_b"), names, strict=True)]
    joined = keyed.join(offsets, matched).drop(*names)
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    return joined.withColumn(rank, F.col("_before") + F.row_number().over(inside)).drop("_before", "_b")


def value_at_rank(df: DataFrame, value: str, place: Column, group: Sequence[str] = (), *, name: str = "value", continuous: bool = False) -> DataFrame:
    """One row a group: the value at 0-based ``place``, an expression of the group's row count ``n``.

    Reads the value off a histogram, so only distinct values are ordered. For ``continuous`` values the histogram may be as long as the
    table: then rows are counted by range first, and only the range that holds the place is ordered. Nulls are left out.
    Columns: the group, ``n`` and ``name``.
    """
    return values_at_ranks(df, value, {name: place}, group, continuous=continuous)


def values_at_ranks(df: DataFrame, value: str, places: dict[str, Column], group: Sequence[str] = (), *, continuous: bool = False) -> DataFrame:
    """The same for several places at once, by name."""
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    if continuous:
        ranged = value_ranges(known, "_v")
        counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*group).orderBy("_range")
        summed = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
        holds = [(F.col("_end") > p) & (F.col("_end") - F.col("_c") <= p) for p in places.values()]
        keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
        hit = summed.where(reduce(or_, holds)).select(*keys, F.col("_range").alias("_at"), "n", (F.col("_end") - F.col("_c")).alias("_before"))
        same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        histogram = ranged.join(F.broadcast(hit) if not group else hit, [F.col("_range") == F.col("_at"), *same]).groupBy(*group, "n", "_at", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
        inside = Window.partitionBy(*group, "_at").orderBy("_v")
        summed = histogram.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    else:
        histogram = known.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*group).orderBy("_v")
        summed = histogram.withColumn("_upto", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
    return summed.groupBy(*group, "n").agg(*[F.min(F.when(F.col("_upto") > p, F.col("_v"))).alias(name) for name, p in places.items()])


def medians(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """group and ``median``, the mean of the lower and the upper median, read off ranges (see :func:`value_at_rank`)."""
    both = values_at_ranks(df, value, {"_low": lower_median(), "_high": upper_median()}, group, continuous=True)
    return both.select(*group, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def floor_quantile(p: float) -> Column:
    """Place ``int((n - 1) * p)``, unlike ``percentile_disc`` which takes the ceiling."""
    return F.floor((F.col("n") - 1) * F.lit(p))


def upper_median() -> Column:
    """Place ``n // 2``."""
    return F.floor(F.col("n") / 2)


def lower_median() -> Column:
    """Place ``(n - 1) // 2``."""
    return F.floor((F.col("n") - 1) / 2)
