"""Problem 1: samples whose category shares match given targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.rand import md5_int
from weftline.ranks import buckets_for


def label_key(label: Column) -> Column:
    """Letters and digits of a label, ignoring case; an empty key stands for no label."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]+", ""))


def proportional_sample(pool: DataFrame, targets: DataFrame, *, record: str = "record_id", label: str = "ds_label", seed: int = 20, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Draw, for each target set, records whose category shares match the targets.

    ``pool`` has columns ``pool``, ``record`` and ``label``; ``targets`` has target_set, pool,
    category, target_share, sample_size and min_count. Returns

    * the sample: target_set, pool, category, record_id, drawn_by (``systematic`` or ``floor``);
    * the report: target_set, pool, category, target_share, wanted, available, drawn, shortfall, sample_size, set_total (rows drawn for
      the whole set), reached_share (drawn / set_total).

    Method: systematic unequal-probability sampling. Within a target set, records lie in order of
    category and then of a random hash. A record's inclusion probability is quota / available; the
    running sum of these probabilities is taken in two steps (a prefix sum over hash buckets, then
    a rank inside each bucket), so no category is ever in one task. A record is selected where the
    running sum plus one random start crosses a whole number. Quotas are whole, so category borders
    fall on whole numbers and each category gets exactly its quota. Then floors are repaired:
    categories below ``min_count`` take further records in the random order. These come on top, so a set with repaired floors is larger than
    its sample_size and its shares are lower than their targets by as much; the report says so.

    Defined cases: a record delivered several times counts once; null and blank labels, and labels
    that are in no target, are never drawn; a null share, size or floor counts as 0; an empty pool
    gives an empty sample and a report that is all shortfall; a category named twice in a set (in two spellings)
    is served once for each name. Further columns of the pool are ignored.
    """
    t = targets.select(
        "target_set", F.col("pool").alias("_pool"), "category", "target_share", "sample_size",
        label_key(F.col("category")).alias("_key"),
        F.round(F.round(F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce(F.col("sample_size"), F.lit(0)), 6)).cast("bigint").alias("_quota"),
        F.coalesce(F.col("min_count"), F.lit(0)).cast("bigint").alias("_floor"),
    )
    wanted_keys = t.select("_pool", "_key").where("_key <> ''").distinct()
    records = (
        pool.select(F.col("pool").alias("_pool"), F.col(record).alias("_id"), label_key(F.col(label)).alias("_key"))
        .where(F.col("_id").isNotNull())
        .join(wanted_keys, ["_pool", "_key"], "left_semi")
        .groupBy("_pool", "_id").agg(F.min("_key").alias("_key"))
    )
    bits = (buckets or buckets_for(pool)).bit_length() - 1
    rows = (
        records.join(t.select("target_set", "_pool", "category", "_key", "_quota", "_floor"), ["_pool", "_key"])
        .withColumn("_h", md5_int(F.concat_ws("#", "_id", "target_set"), f"{seed}.order"))
        .withColumn("_b", F.shiftright(F.col("_h"), 32 - bits))
    )
    group = ["target_set", "category"]
    counts = rows.groupBy(*group, "_quota", "_floor", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_available"),
    )
    inside = Window.partitionBy(*group, "_b").orderBy("_h", "_id")
    ranked = rows.join(offsets, [*group, "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside))

    quota = F.least(F.col("_quota"), F.col("_available"))
    # whole numbers of up to 38 digits: no product overflows, and every engine draws the same rows
    wide = lambda c: c.cast("decimal(19,0)")
    start = F.call_function("div", wide(F.col("_available")) * wide(md5_int("target_set", f"{seed}.start")), wide(F.lit(1 << 32)))
    mass = lambda r: F.call_function("div", wide(r) * wide(quota) + wide(start), wide(F.col("_available")))
    crossed = mass(F.col("_rank")) > mass(F.col("_rank") - 1)
    passed_over = F.col("_rank") - mass(F.col("_rank"))
    missing = F.least(F.col("_floor"), F.col("_available")) - quota
    sample = ranked.select(
        "target_set", F.col("_pool").alias("pool"), "category", F.col("_id").alias("record_id"),
        F.when(crossed, "systematic").when(passed_over <= missing, "floor").alias("drawn_by"),
    ).where("drawn_by is not null")

    drawn = sample.groupBy(*group).agg(F.count(F.lit(1)).alias("drawn"))
    held = offsets.groupBy(*group).agg(F.max("_available").alias("available"))
    report = (
        t.join(held, group, "left").join(drawn, group, "left")
        .select(
            "target_set", F.col("_pool").alias("pool"), "category", "target_share",
            F.greatest("_quota", "_floor").alias("wanted"),
            F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("drawn", F.lit(0)).alias("drawn"),
        )
        .withColumn("shortfall", F.col("wanted") - F.col("drawn"))
        .join(t.groupBy("target_set").agg(F.max("sample_size").alias("sample_size")), "target_set")
        .join(drawn.groupBy("target_set").agg(F.sum("drawn").alias("set_total")), "target_set", "left")
        .withColumn("set_total", F.coalesce("set_total", F.lit(0)))
        .withColumn("reached_share", F.when(F.col("set_total") > 0, F.round(F.col("drawn") / F.col("set_total"), 9)).otherwise(0.0))
    )
    return sample, report
