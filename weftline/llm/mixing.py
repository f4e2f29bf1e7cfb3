"""Problem 2: mixing sources to target shares with a capped number of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.rand import md5_unit
from weftline.ranks import shuffled_rank


def name_key(name: Column) -> Column:
    """Dataset names are equal ignoring case, outer blanks and hyphen against underscore."""
    return F.lower(F.translate(F.regexp_replace(name, r"^\s+|\s+$", ""), "-", "_"))


def mix_sources(records: DataFrame, targets: DataFrame, configs: DataFrame, *, record: str = "point_id", source: str = "datapoint_type", size: str | None = None, seed: int = 31) -> tuple[DataFrame, DataFrame]:
    """Combine records so that each source has its target share of each mix.

    ``targets``: mix_id, dataset_name, target_share, total_records, max_repeats; ``configs``:
    dataset_name, num_train, updated_at. Returns

    * the mix: mix_id, dataset_name, record_id, copies (1 or more);
    * the report: mix_id, dataset_name, target_share, wanted, usable, capacity, expected, drawn, size_drawn, share, deviation.

    Method: sizes are added up for each source, giving a repetition rate = wanted / total, at most
    max_repeats; a record is emitted floor(rate) times plus once more with probability equal to the
    fraction, by a Bernoulli draw seeded with a hash of the record and the mix. A source uses at most num_train distinct records, the first
    in hash order; only sources that hold more are ranked.

    Without ``size`` each record has the size 1, so shares are of records; with it (a column, e.g. tokens)
    total_records is a total of sizes. Draws are independent, so shares are met in expectation: ``expected`` is
    the size that the rates give, ``share`` what was reached and ``deviation`` how far that is from the target.

    Defined cases: a record delivered several times is one record; null names match nothing; a
    dataset without config or without num_train has no limit on distinct records, of several configs the latest holds;
    null shares, totals or repeats count as 0; a source without records is reported with drawn 0;
    null or negative sizes count as 0. Further columns are ignored.
    """
    t = targets.select(
        "mix_id", "dataset_name", "target_share", name_key(F.col("dataset_name")).alias("_key"),
        F.round(F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("total_records", F.lit(0)), 6)).cast("bigint").alias("wanted"),
        F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("_repeats"),
    )
    limits = (
        configs.select(name_key(F.col("dataset_name")).alias("_key"), "num_train", "updated_at")
        .where("_key is not null").groupBy("_key").agg(F.max_by("num_train", F.struct("updated_at", "num_train")).cast("bigint").alias("_limit"))
    )
    amount = F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)) if size else F.lit(1.0)
    distinct = (
        records.select(F.col(record).alias("_id"), name_key(F.col(source)).alias("_key"), amount.alias("_size"))
        .where(F.col("_id").isNotNull())
        .join(t.select("_key").distinct(), "_key", "left_semi")
        .groupBy("_id").agg(F.min("_key").alias("_key"), F.max("_size").alias("_size"))
    )
    held = distinct.groupBy("_key").agg(F.count(F.lit(1)).alias("_held")).join(limits, "_key", "left")
    over = F.coalesce(F.col("_held") > F.col("_limit"), F.lit(False))
    ranked = shuffled_rank(distinct.join(held.where(over).select("_key", "_limit"), "_key"), "_id", f"{seed}.limit", ["_key"]).where("rank <= _limit")
    used = distinct.join(held.where(~over).select("_key"), "_key").select("_id", "_key", "_size").unionByName(ranked.select("_id", "_key", "_size"))
    totals = used.groupBy("_key").agg(F.count(F.lit(1)).alias("usable"), F.sum("_size").alias("_total"))
    rate = F.when(F.col("_total") > 0, F.least(F.col("_repeats").cast("double"), F.col("wanted") / F.col("_total"))).otherwise(0.0)
    plan = t.join(totals, "_key", "left").withColumns({"usable": F.coalesce("usable", F.lit(0)), "_total": F.coalesce("_total", F.lit(0.0))}).withColumn("_rate", rate)
    group = ["mix_id", "dataset_name"]
    extra = md5_unit(F.concat_ws("#", "_id", *group), f"{seed}.copy") < F.col("_rate") - F.floor("_rate")
    copies = F.floor("_rate") + extra.cast("bigint")
    mix = used.join(plan.select("_key", *group, "_rate"), "_key").select(*group, F.col("_id").alias("record_id"), copies.cast("int").alias("copies"), "_size").where("copies > 0")
    drawn = mix.groupBy(*group).agg(F.sum("copies").alias("drawn"), F.sum(F.col("copies") * F.col("_size")).alias("size_drawn"))
    per_mix = drawn.groupBy("mix_id").agg(F.sum("size_drawn").alias("_all"))
    joined = plan.join(drawn, group, "left").join(per_mix, "mix_id", "left").withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "size_drawn": F.coalesce("size_drawn", F.lit(0.0))})
    share = F.when(F.col("_all") > 0, F.col("size_drawn") / F.col("_all")).otherwise(0.0)
    report = joined.select(
        *group, "target_share", "wanted", "usable", (F.col("_total") * F.col("_repeats")).alias("capacity"), (F.col("_rate") * F.col("_total")).alias("expected"),
        "drawn", "size_drawn", share.alias("share"), (share - F.coalesce("target_share", F.lit(0.0))).alias("deviation"),
    )
    return mix.drop("_size"), report
