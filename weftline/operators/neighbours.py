"""Nearest neighbours by cosine, as blocked matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """The ``k`` nearest rows of the corpus for each query, itself excluded: key, neighbour, rank, similarity.

    Both sides are packed in the scan into rows that hold ``block`` unit vectors each; every block of
    queries meets every block of the corpus as one matrix product, and only the best ``k`` of a block
    are passed on. So pairs of vectors never become rows: the shuffle carries queries x corpus
    blocks x k rows, and nothing is collected. Equal similarities are ordered by id.
    Null, empty and zero vectors have no neighbours. Vectors must be of one length; ids are whole numbers.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                m = np.array(part.column(1).to_pylist(), dtype=np.float64)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                keep = length[:, 0] > 0
                m, ids = (m / np.maximum(length, 1e-300))[keep], np.array(part.column(0).to_pylist(), np.int64)[keep]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "rows"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qm, ci, cm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, c = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                if not len(q) or not len(c):
                    continue
                sims = np.frombuffer(qm).reshape(len(q), -1) @ np.frombuffer(cm).reshape(len(c), -1).T
                sims[q[:, None] == c[None, :]] = -np.inf
                n = min(k, len(c))
                least = np.partition(sims, len(c) - n, axis=1)[:, len(c) - n]  # the n-th greatest of each row, without sorting the rest
                held = (sims >= least[:, None]) & np.isfinite(sims)
                for i in np.flatnonzero(held.sum(axis=1) > n):  # ties at the border: the least ids stay
                    tied = np.flatnonzero(held[i])
                    held[i, tied[np.lexsort((c[tied], -sims[i, tied]))[n:]]] = False
                row, column = np.nonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(c[column]), pa.array(sims[row, column])], ["q", "c", "s"])

    def packed(df: DataFrame, a: str, b: str) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return rows.mapInArrow(pack, "ids binary, rows binary").toDF(a, b)

    met = packed(queries, "qi", "qm").crossJoin(packed(corpus, "ci", "cm"))
    best = met.mapInArrow(match, "q bigint, c bigint, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(key), F.col("c").alias("neighbour"), "rank", F.col("s").alias("similarity"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, *, key: str = "vec_id", vector: str = "v", name: str = "guess", digits: int = 9, block: int = 4096) -> DataFrame:
    """For each point the name of the centroid at the least squared distance (rounded to ``digits``; the least name on a tie): key, name.

    Centroids (name, vector) are one row a class, so as few as the classes of a classifier, and are broadcast. Both are packed into blocks of unboxed numbers; each block of points meets a block of centroids as one
    matrix product, so pairs of points and centroids never become rows. Points without a vector have no nearest centroid.
    """
    kind = dict(points.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([np.array(part.column(1).to_pylist(), np.float64).tobytes()], pa.binary())], ["names", "rows"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_type, name_type = (batch.schema.field(i).type.value_type for i in (0, 2))
            for keys, points_, names, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order = np.array(sorted(range(len(names)), key=names.__getitem__))
                p, m = np.frombuffer(points_).reshape(len(keys), -1), np.frombuffer(rows).reshape(len(names), -1)[order]
                far = np.round((p * p).sum(1)[:, None] - 2 * p @ m.T + (m * m).sum(1)[None, :], digits)
                best = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([names[order[i]] for i in best], name_type), pa.array(far[np.arange(len(p)), best])], ["k", "c", "d"])

    def packed(df: DataFrame, column: str, values: str) -> DataFrame:
        rows = df.where(F.col(values).isNotNull()).select(F.col(column), F.col(values).cast("array<double>"))
        return rows.mapInArrow(pack, f"names array<{dict(df.dtypes)[column]}>, rows binary")

    met = packed(points, key, vector).toDF("keys", "points").crossJoin(F.broadcast(packed(centroids, name, vector))).mapInArrow(match, f"k {kind}, c {dict(centroids.dtypes)[name]}, d double")
    return met.groupBy("k").agg(F.min_by("c", F.struct("d", "c")).alias(name)).withColumnRenamed("k", key)
