"""Structured Streaming jobs: stateful packing, ratio mixing, windows and a metrics sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.rand import md5_below
from weftline.storage import step_folder


def table_stream(spark: SparkSession, folder: str, name: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, name: str, *, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there now and read what it wrote. Output and progress lie in the shared folder.

    In ``update`` mode each batch writes the rows that it changed, by ``keys``; the last state of each is read back, and a batch
    that is tried again replaces its own rows.
    """
    spark = stream.sparkSession
    base = step_folder(spark, name)
    if mode == "append":
        stream.writeStream.outputMode("append").option("checkpointLocation", base + "/progress").trigger(availableNow=True).format("parquet").start(base + "/rows").awaitTermination()
    else:

        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

        stream.writeStream.outputMode(mode).option("checkpointLocation", base + "/progress").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
        rows = spark.read.parquet(base + "/rows")
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")
    return spark.read.parquet(base + "/rows")


def packed_stream(stream: DataFrame, group: list[str], key: str, size: str, least: int) -> DataFrame:
    """Greedy packing with state (size so far, pack number) for each group: group columns, key, size, pack_id.

    Rows must arrive in order of ``key`` from one batch to the next; within a batch they are sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        filled, pack = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(key)
        packs = []
        for n in rows[size]:
            packs.append(pack)
            filled += int(n)
            if filled >= least:
                filled, pack = 0, pack + 1
        state.update((filled, pack))
        yield pd.DataFrame({**dict(zip(group, keys, strict=True)), key: rows[key], size: rows[size], "pack_id": packs})

    out = ", ".join(f"{c} {kinds[c]}" for c in (*group, key, size)) + ", pack_id int"
    return stream.select(*group, key, size).groupBy(*group).applyInPandasWithState(step, out, "filled bigint, pack int", "append", GroupStateTimeout.NoTimeout)


def mixed_stream(left: DataFrame, right: DataFrame, key: str, n: int, m: int, *, lanes: int = 1) -> DataFrame:
    """Two streams at a ratio of n to m: each row gets its place in the round by a running count of its side.

    Rows are dealt to ``lanes`` by a hash of their key; each lane keeps its own counts, so as many tasks share a side, and the lanes' places alternate.
    """
    both = left.select(F.col(key), F.lit("left").alias("source")).unionByName(right.select(F.col(key), F.lit("right").alias("source")))
    dealt = both.withColumn("_lane", md5_below(key, "lane", lanes).cast("int"))
    kind = dict(both.dtypes)[key]

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(key)
        at = pd.Series(range(seen, seen + len(rows)))
        take, shift = (n, 0) if keys[0] == "left" else (m, n)
        state.update((seen + len(rows),))
        yield pd.DataFrame({key: rows[key].to_numpy(), "source": keys[0], "pos": ((at // take) * (n + m) + shift + at % take) * lanes + int(keys[1])})

    return dealt.groupBy("source", "_lane").applyInPandasWithState(step, f"{key} {kind}, source string, pos bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def window_counts(stream: DataFrame, time: str, kind: str, value: str, *, width: str = "1 day", every: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums by kind and tumbling window, or sliding window if ``every`` is shorter than ``width``; rows later than the watermark are dropped, and windows before it leave the state."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", width, every) if every else F.window("_t", width)
    return timed.groupBy(window, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def session_counts(stream: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each key, which end once nothing comes for ``gap``: key, start, end, n. A session is written when the watermark has passed it."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def metrics_sink(stream: DataFrame, path: str, progress: str) -> None:
    """Scalars by step appended to a table, batch by batch; a batch that is tried again replaces its own rows."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
