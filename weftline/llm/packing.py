"""Problem 7: filling containers of fixed capacity with whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokenizers
from weftline.ranks import buckets_for, hashed_rank
from weftline.storage import materialize


def best_fit_runs(histogram: Mapping[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit by classes: largest sizes first, each item into the smallest gap that holds it.

    ``histogram`` has the number of items of each size in 1..capacity. A gap class is a set of
    containers with equal room, kept as ranges of container numbers. A superstep takes one size
    class and sweeps the gap classes from its successor upwards; the items of the size class and the
    containers of a gap class pair off by rank, so no container is claimed twice, and the
    containers move to their new gap classes before the sweep goes on. Without a gap that fits, new
    containers open.

    Returns runs (size, first rank, first container, containers, items): item i of the run goes to
    container first + i mod containers. With them, the number of containers. The work grows with
    the number of size and gap classes, so with the capacity, not with the number of items.
    """
    present = np.zeros(capacity + 1, np.uint8)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, opened = [], 0

    def put(gap: int, start: int, count: int) -> None:
        if gap > 0 and count > 0:
            gaps[gap].append((start, count))
            present[gap] = 1

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            gap = size + int(present[size:].argmax())
            if present[gap]:
                start, count = gaps[gap].pop()
                if not gaps[gap]:
                    present[gap] = 0
            else:
                gap, start, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            # best fit puts the next item of this size into the same container while it fits
            each = gap // size
            full = min(count, left // each)
            if full:
                runs.append((size, rank, start, full, full * each))
                rank, left = rank + full * each, left - full * each
                put(gap - each * size, start, full)
            if full < count:
                used = 0
                if left:
                    runs.append((size, rank, start + full, 1, left))
                    put(gap - left * size, start + full, 1)
                    rank, left, used = rank + left, 0, 1
                put(gap, start + full + used, count - full - used)
    return runs, opened


@dataclass
class RunTable:
    """Runs in order of class (spec, size) and rank. ``keys`` are class number and rank in one whole number of 63 bits, shared out as the counts need."""

    classes: np.ndarray
    shift: int
    width: int
    keys: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def containers(self, spec: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = np.searchsorted(self.classes, spec * self.width + size) << self.shift | rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.starts[at] + (key - self.keys[at]) % self.counts[at]


def run_table(runs: list[list[tuple[int, int, int, int, int]]]) -> RunTable:
    """The runs of several specs, numbered from 0, as one table to look containers up in."""
    flat = np.array([(spec, *run) for spec, rs in enumerate(runs) for run in sorted(rs)], np.int64).reshape(-1, 6)
    spec, size, rank, start, count, _ = flat.T
    width = int(size.max(initial=0)) + 1
    classes, number = np.unique(spec * width + size, return_inverse=True)
    shift = int((flat[:, 2] + flat[:, 5]).max(initial=1)).bit_length()
    if shift + len(classes).bit_length() > 63:
        raise OverflowError("more runs than 63 bits can tell apart")  # beyond 10^18 items times classes
    return RunTable(classes, shift, width, number << shift | rank, start, count)


def token_sizes(df: DataFrame, names: list[str], *, key: str = "doc_id", text: str = "text", folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """One row (key, sizes) a row: the sizes of its text under each tokenizer, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizers.UnitCounter(names, folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = counter.counts(texts).ravel()
            ends = np.arange(0, len(sizes) + 1, len(names), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes))], ["key", "sizes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, sizes array<bigint>")


def pack_texts(df: DataFrame, specs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = tokenizers.TOKENIZER_DIR, seed: int = 7) -> DataFrame:
    """Assign every text of ``df`` to containers, for each row of ``specs`` (spec_id, tokenizer, capacity_tokens).

    Returns spec_id, key, piece, container_id, n_tokens. A text stays whole unless it exceeds the
    capacity; such a text is cut into full containers and one remainder, which is packed like a text.

    Method: bulk-synchronous best fit. Sizes and gaps are whole numbers up to the capacity, so
    items are sorted by counting: one pass encodes all texts, one aggregation counts the items of
    each size (at most capacity_tokens rows for a spec go to the driver), the supersteps of
    :func:`best_fit_runs` match size classes with gap classes, and each item finds its container
    from its rank within its size class. Ranks come from hash buckets, so a size that a third of
    the texts have is spread over the cluster.

    Defined cases: null and empty texts (0 tokens) lie in container 0 with 0 tokens; rows with equal
    keys are separate items; an empty table gives no rows. ``specs`` is read to the driver, as a spec table is small; any capacity
    from one token up and any number of specs will do. A spec without a tokenizer or a positive capacity is an error before any text is read.
    """
    rows = specs.select("spec_id", "tokenizer", "capacity_tokens").orderBy("spec_id").collect()
    if any(not r.tokenizer or not r.capacity_tokens or r.capacity_tokens < 1 for r in rows):
        raise ValueError("each spec needs a tokenizer and a capacity of at least one token")
    wanted = [(r.spec_id, r.tokenizer, int(r.capacity_tokens)) for r in rows]
    if not wanted:
        kinds = f"spec_id {specs.schema['spec_id'].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, piece int, container_id bigint, n_tokens bigint"
        return df.sparkSession.createDataFrame([], kinds)
    names = sorted({name for _, name, _ in wanted})
    sized = materialize(token_sizes(df, names, key=key, text=text, folder=folder), "sizes")

    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).cast("bigint").alias("capacity"), F.lit(names.index(n)).alias("t")) for i, (_, n, c) in enumerate(wanted)]))
    items = (
        sized.select("key", "sizes", spec.alias("s"))
        .select("key", "s.spec", "s.capacity", F.get("sizes", F.col("s.t")).alias("total"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("total") - 1) / F.col("capacity")), F.lit(0)))))
        .select("key", "spec", F.col("piece").cast("int").alias("piece"), F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")).alias("size"))
    )
    counted = items.where("size > 0").groupBy("spec", "size").agg(F.count(F.lit(1)).alias("n"))
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counted.collect():
        histograms[r["spec"]][r["size"]] = r["n"]

    # runs lie in order of spec, size and rank; a class (spec, size) knows where its own begin, so a rank is looked up within its class
    found = df.sparkSession.sparkContext.broadcast(run_table([best_fit_runs(histograms[i], capacity)[0] for i, (_, _, capacity) in enumerate(wanted)]))

    @F.pandas_udf("bigint")
    def container(spec: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(found.value.containers(spec.to_numpy(np.int64), size.to_numpy(np.int64), rank.to_numpy(np.int64) - 1))

    ids = F.element_at(F.create_map(*[x for i, (s, _, _) in enumerate(wanted) for x in (F.lit(i), F.lit(s))]), F.col("spec"))
    ranked = hashed_rank(items.where("size > 0"), ["spec", "size"], ["key", "piece"], seed, buckets=buckets_for(sized, 64))
    packed = ranked.select(ids.alias("spec_id"), F.col("key").alias(key), "piece", container("spec", "size", "rank").alias("container_id"), F.col("size").alias("n_tokens"))
    empty = items.where("size <= 0").select(ids.alias("spec_id"), F.col("key").alias(key), "piece", F.lit(0).cast("bigint").alias("container_id"), F.lit(0).cast("bigint").alias("n_tokens"))
    return packed.unionByName(empty)
