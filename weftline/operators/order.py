"""Order-dependent operators: shuffles, splits, shards, length grouping, interleaving and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.ranks import bucketed_rank, floor_quantile, shuffled_rank, value_at_rank, value_rank


def trim_by_quantile(df: DataFrame, length: str, p: float) -> DataFrame:
    """Rows whose length is at most the floor quantile, with column ``threshold``. Null lengths are dropped."""
    limit = value_at_rank(df, length, floor_quantile(p), name="threshold").select("threshold")
    return df.crossJoin(F.broadcast(limit)).where(F.col(length) <= F.col("threshold"))


def length_grouped(df: DataFrame, key: str, length: str, *, salt: str, batch: int, multiplier: int) -> DataFrame:
    """Shuffle, cut into mega-batches of ``batch * multiplier`` rows and sort each by falling length; ``new_pos`` from 0."""
    size = batch * multiplier
    shuffled = shuffled_rank(df, key, salt, rank="_at").withColumn("_chunk", F.floor((F.col("_at") - 1) / size))
    inside = Window.partitionBy("_chunk").orderBy(F.col(length).desc_nulls_last(), "_at")
    return shuffled.withColumn("new_pos", F.col("_chunk") * size + F.row_number().over(inside) - 1).drop("_at", "_chunk")


def strided_shards(df: DataFrame, key: str, world: int, batch: int, *, salt: str) -> DataFrame:
    """Rows dealt round to ``world`` shards (``shard``, ``shard_pos`` from 0); rows beyond whole batches of every shard are dropped."""
    dealt = shuffled_rank(df, key, salt, rank="_at")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    kept = dealt.crossJoin(F.broadcast(total)).where(F.col("_at") <= F.floor(F.col("_n") / (world * batch)) * world * batch)
    return kept.withColumn("shard", F.pmod(F.col("_at") - 1, F.lit(world))).withColumn("shard_pos", F.floor((F.col("_at") - 1) / world)).drop("_at", "_n")


def head_tail_split(df: DataFrame, key: str, *, train: int, test: int, salt: str) -> DataFrame:
    """``split``: the first ``train`` rows of a shuffle and the last ``test``, never the same row; others null. A test size of 0 is an empty test."""
    ranked = shuffled_rank(df, key, salt, rank="_at").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    is_train = F.col("_at") <= F.least(F.lit(train), F.greatest(F.col("_n") - test, F.lit(0)))
    split = F.when(is_train, "train").when(F.col("_at") > F.col("_n") - test, "test")
    return ranked.withColumn("split", split).drop("_at", "_n")


def proportional_split(df: DataFrame, key: str, shares: dict[str, float], *, salt: str) -> DataFrame:
    """``part``: contiguous runs of a shuffle, each ``ceil(share * n)`` long, the last one whatever is left."""
    ranked = shuffled_rank(df, key, salt, rank="_at").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    upto: Column = F.lit(0)
    part = None
    for name, share in list(shares.items())[:-1]:
        upto = upto + F.ceil(F.lit(share) * F.col("_n"))
        part = part.when(F.col("_at") <= upto, name) if part is not None else F.when(F.col("_at") <= upto, name)
    last = list(shares)[-1]
    return ranked.withColumn("part", part.otherwise(last) if part is not None else F.lit(last)).drop("_at", "_n")


def balanced(df: DataFrame, key: str, label: str, *, salt: str) -> DataFrame:
    """As many rows of each label as the scarcest has, the first of a shuffle. Null labels are dropped."""
    known = df.where(F.col(label).isNotNull())
    least = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))
    return shuffled_rank(known, key, salt, [label], rank="_at").crossJoin(F.broadcast(least)).where("_at <= _least").drop("_at", "_least")


def interleave(left: DataFrame, right: DataFrame, key: str, n: int, m: int, *, partial: bool = False) -> DataFrame:
    """``n`` rows of the left, then ``m`` of the right, and so on, each in order of ``key``: columns key, source, pos.

    Ends with the last whole cycle that both can fill, or with all rows if ``partial``.
    """
    a = value_rank(left.select(key), key, key, rank="_at").select(key, F.lit("left").alias("source"), F.floor((F.col("_at") - 1) / n).alias("cycle"), F.pmod(F.col("_at") - 1, F.lit(n)).alias("_in"))
    b = value_rank(right.select(key), key, key, rank="_at").select(key, F.lit("right").alias("source"), F.floor((F.col("_at") - 1) / m).alias("cycle"), (n + F.pmod(F.col("_at") - 1, F.lit(m))).alias("_in"))
    both = a.unionByName(b)
    if not partial:
        na, nb = left.agg(F.count(F.lit(1)).alias("_na")), right.agg(F.count(F.lit(1)).alias("_nb"))
        both = both.crossJoin(F.broadcast(na)).crossJoin(F.broadcast(nb)).where(F.col("cycle") < F.least(F.floor(F.col("_na") / n), F.floor(F.col("_nb") / m))).drop("_na", "_nb")
        return both.select(key, "source", (F.col("cycle") * (n + m) + F.col("_in")).alias("pos"))
    ranked = bucketed_rank(both, [], F.col("cycle"), [F.col("cycle"), F.col("_in")], rank="_pos")
    return ranked.select(key, "source", (F.col("_pos") - 1).alias("pos"))


def pack_greedily(df: DataFrame, source: str, key: str, size: Column, least: int, *, block: str | None = None) -> DataFrame:
    """Consecutive rows of a source form a pack until its sizes reach ``least``: columns source, key, pack_id (from 0).

    A fold over the ordered rows of a source; give a block column that never falls as ``key`` rises (e.g. an id range) so that a
    source never has to fit one task. Packs run on over block borders: each block is first folded from every row at which its
    first pack can end, the blocks of a source are chained by that, and each is folded again from what it is entered with.
    An unfinished last pack is kept.
    """
    group = [source, *([block] if block else [])]
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), size.cast("bigint").alias("n"))))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("chars"), F.lit(0).alias("pack"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, row: Column) -> Column:
        full = acc["chars"] + row["n"] >= least
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(acc["chars"] + row["n"]).alias("chars"),
            (acc["pack"] + full.cast("int")).alias("pack"),
            F.concat(acc["ids"], F.array(acc["pack"])).alias("ids"),
        )

    def count(acc: Column, row: Column) -> Column:
        full = acc["chars"] + row["n"] >= least
        return F.struct(F.when(full, zero).otherwise(acc["chars"] + row["n"]).alias("chars"), (acc["pack"] + full.cast("int")).alias("pack"))

    def first_ends(acc: Column, row: Column) -> Column:
        open_ = (acc["sum"] < least) & (row["n"] > 0)
        end = F.struct((acc["sum"] + row["n"]).alias("sum"), (acc["at"] + 1).alias("at"))
        return F.struct((acc["sum"] + row["n"]).alias("sum"), (acc["at"] + 1).alias("at"), F.when(open_, F.concat(acc["ends"], F.array(end))).otherwise(acc["ends"]).alias("ends"))

    def chain(acc: Column, b: Column) -> Column:
        hit = F.get(F.filter(b["ends"], lambda e: acc["chars"] + e["sum"] >= least), F.lit(0))
        entry = F.struct(b["block"].alias("block"), acc["chars"].alias("chars"), acc["pack"].alias("pack"))
        return F.struct(
            F.when(hit.isNull(), acc["chars"] + b["sum"]).otherwise(hit["rest"]["chars"]).alias("chars"),
            F.when(hit.isNull(), acc["pack"]).otherwise(acc["pack"] + 1 + hit["rest"]["pack"]).alias("pack"),
            F.concat(acc["entries"], F.array(entry)).alias("entries"),
        )

    folded = df.groupBy(*group).agg(rows.alias("_rows"))
    if block:
        kind = dict(df.dtypes)[block]
        none = F.struct(zero.alias("sum"), F.lit(0).alias("at"), F.array().cast("array<struct<sum:bigint,at:int>>").alias("ends"))
        ends = folded.select(*group, "_rows", F.aggregate("_rows", none, first_ends).alias("_e"))
        after = lambda e: F.aggregate(F.slice("_rows", e["at"] + 1, F.size("_rows")), F.struct(zero.alias("chars"), F.lit(0).alias("pack")), count)
        known = F.transform("_e.ends", lambda e: F.struct(e["sum"].alias("sum"), after(e).alias("rest")))
        blocks = ends.select(source, F.struct(F.col(block).alias("block"), F.col("_e.sum").alias("sum"), known.alias("ends")).alias("_b"))
        begin = F.struct(zero.alias("chars"), F.lit(0).alias("pack"), F.array().cast(f"array<struct<block:{kind},chars:bigint,pack:int>>").alias("entries"))
        chained = blocks.groupBy(F.col(source).alias("_s")).agg(F.array_sort(F.collect_list("_b")).alias("_bs")).select("_s", F.explode(F.aggregate("_bs", begin, chain)["entries"]).alias("_in"))
        folded = folded.join(chained, F.col(source).eqNullSafe(F.col("_s")) & F.col(block).eqNullSafe(F.col("_in.block")))
        start = F.struct(F.col("_in.chars").alias("chars"), F.col("_in.pack").alias("pack"), F.array().cast("array<int>").alias("ids"))
    folded = folded.withColumn("_ids", F.aggregate("_rows", start, step)["ids"])
    pairs = folded.select(*group, F.explode(F.arrays_zip(F.col("_rows"), F.col("_ids"))).alias("_p"))
    return pairs.select(*group, F.col("_p._rows.k").alias(key), F.col("_p._rows.n").alias("size"), F.col("_p._ids").alias("pack_id"))
