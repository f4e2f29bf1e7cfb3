"""Probes fitted on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vectors import doubles


def standardized(rows: DataFrame, vector: str, is_train: str, *, least: float = 1e-6) -> DataFrame:
    """``rows`` with ``z``: the vector less the means of the training rows over their deviations, which are at least ``least``.

    The statistics are one row of two arrays, added up in each partition; null vectors stay null.
    """
    x = rows.withColumn("_v", doubles(F.col(vector)))
    train = x.where(is_train).select(F.posexplode("_v").alias("dim", "x"))
    by = train.groupBy("dim").agg(F.avg("x").alias("mu"), F.greatest(F.stddev_pop("x"), F.lit(least)).alias("sd"))
    stats = by.agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("_s"))  # one entry a dimension
    z = F.zip_with("_v", "_s", lambda v, s: (v - s["mu"]) / s["sd"])
    return x.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("_v", "_s")


def softmax_probe(rows: DataFrame, vector: str, label: str, is_train: str, *, iterations: int = 50, decay: float = 1e-4) -> DataFrame:
    """A linear softmax probe fitted on the training rows: ``rows`` with ``label_index`` and ``guess``, the index of the label it holds most probable.

    Labels become indices in sorted order of the training labels; a test label that isn't among them is an error. Vectors are
    standardized by the training rows. The fit is by L-BFGS over partial gradients of the partitions, with weight decay; rows
    aren't gathered. Rows with a null vector or label are left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    labels = known.where(is_train).agg(F.array_sort(F.collect_set(label)).alias("_labels"))  # the classes of a probe are few
    place = F.array_position("_labels", F.col(label)) - 1
    seen = F.when(place >= 0, place).otherwise(F.raise_error(F.lit("a test label is not among the training labels")))
    indexed = standardized(known, vector, is_train).crossJoin(F.broadcast(labels)).withColumn("label_index", seen.cast("double")).withColumn("features", array_to_vector("z")).drop("_labels", "z")
    model = LogisticRegression(featuresCol="features", labelCol="label_index", predictionCol="guess", maxIter=iterations, regParam=decay, family="multinomial", standardization=False, tol=1e-9)
    fitted = model.fit(indexed.where(is_train))
    return fitted.transform(indexed).drop("features", "rawPrediction", "probability")
