"""Memoised requests: hits from a table of earlier responses, misses through a provider, once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import request_key

#: A provider answers a batch of prompts; it is the border to models, which are outside this engine.
Provider = Callable[[pd.Series], pd.Series]


def latest(cache: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last response written for each key."""
    rest = [c for c in cache.columns if c not in (key, seq)]
    return cache.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def respond(requests: DataFrame, prompt: str, provider: Provider, *, parallel: int | None = None) -> DataFrame:
    """``requests`` with a column ``response``; batches go to the provider on ``parallel`` partitions, order of rows aside."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(response=provider(b[prompt]))

    return (requests.repartition(parallel) if parallel else requests).mapInPandas(run, schema)


def cached(requests: DataFrame, cache: DataFrame, prompt: str, provider: Provider, *config: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, additions): all requests with ``key``, ``response`` and ``hit``; and the rows to append to the cache.

    Equal requests are asked once. A cached null response (a refused request) counts as a hit.
    """
    keyed = requests.withColumn("key", request_key(F.col(prompt), *config))
    known = latest(cache).select("key", F.col("response").alias("_old"), F.lit(True).alias("_known"))
    joined = keyed.join(known, "key", "left")
    asked = joined.where("_known is null").select("key", prompt).dropDuplicates(["key"])
    new = respond(asked, prompt, provider).select("key", "response")
    answers = joined.join(new, "key", "left").withColumn("hit", F.coalesce("_known", F.lit(False))).withColumn("response", F.when(F.col("hit"), F.col("_old")).otherwise(F.col("response")))
    return answers.drop("_old", "_known"), new


def respond_in_order(requests: DataFrame, prompt: str, order: str, provider: Provider, *, parallel: int) -> DataFrame:
    """Responses with ``ordinal`` (0, 1, ...), the place of their request by ``order``: at most ``parallel`` batches are under way, and the order can be told afterwards."""
    from weftline.ranks import value_rank

    numbered = value_rank(requests, order, order, rank="ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    return respond(numbered, prompt, provider, parallel=parallel)
