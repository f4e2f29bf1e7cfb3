"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import evals
from weftline.plans import composites, corpus, features, files, panels, scores, sequences, shapes, statements, texts, vectors  # noqa: F401  (the import registers the queries)
from weftline.plans.registry import QUERIES, SQL
from weftline.rand import md5_below


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Language questions made of documents, answered by a keyed stand-in for a model, scored by label with intervals."""
    asked = QUERIES["q10_lang_id_qa"](spark, d)
    said = F.when(md5_below(F.concat_ws("#", "doc_id", "question"), "answer", 10) < 8, F.col("answer")).otherwise("No")
    return evals.score_table(asked.withColumn("response", said), ["ds_label"], text.matches_exactly(F.col("response"), F.col("answer")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
