"""Problems 3 and 6: encoding and counting every text under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokenizers
from weftline.llm.languages import code_column
from weftline.llm.mixing import name_key


def encode_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """One row (key, ids) for each row: the ids of the whole text, without special tokens.

    Nothing is shuffled: each scan partition is encoded in Arrow batches by a tokenizer loaded once
    per Python worker. Empty and null texts give an empty list; special strings in a text are
    ordinary text; rows with equal keys or texts each give a row. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers.load(tokenizer, folder)
        for batch in batches:
            ids = tok.ids(batch.column(1).to_pylist())
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, *, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the exact number of tokens of each text; 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizers.UnitCounter([tokenizer], folder)
        for batch in batches:
            counts = counter.counts(batch.column(0).to_pylist())[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*names, "n_tokens"])

    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keep, strict=True))
    picked = df.select(F.col(text).cast("string").alias("text"), *[F.col(k).alias(n) for n, k in zip(names, keep, strict=True)])
    out = picked.mapInArrow(run, f"{kinds}{', ' if keep else ''}n_tokens bigint")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], "n_tokens")


def unpadded_size(ids: Column, pad: int = 0) -> Column:
    """Length of a token list without its left padding; 0 for null."""
    first = F.array_position(F.transform(ids, lambda x: F.coalesce(x != pad, F.lit(True))), True)
    return F.when(first > 0, F.size(ids) - first + 1).otherwise(F.lit(0)).cast("bigint")


def token_budget(documents: DataFrame, points: DataFrame, *, tokenizer: str = "byte_bpe_50k", folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """Token totals of texts and token lists over the cube of source, language and domain.

    ``documents``: text, source, lang, domain; ``points``: point_id, datapoint_type, input_ids, lang, domain.
    Returns record_table, source, lang, domain, level, n_records, n_tokens, where ``level`` has a bit
    for each column summed over (4 source, 2 lang, 1 domain); level 0 is the finest.

    Documents are encoded once, in the scan; partial sums leave each partition, so the shuffle
    carries a row for each combination of values, whatever the number of documents. Points
    delivered several times count once; left padding isn't counted. Languages are spelled as two
    letters where they name a language (else null), datapoint types in lower case with underscores.
    Null values form groups of their own. Null and empty texts count as records of 0 tokens.
    """
    texts = token_counts(documents, keep=["source", "lang", "domain"], tokenizer=tokenizer, folder=folder).select(
        F.lit("documents").alias("record_table"), "source", code_column("lang").alias("lang"), "domain", "n_tokens"
    )
    return _cube(texts.unionByName(_point_sizes(points)))


def point_budget(points: DataFrame) -> DataFrame:
    """The same over token lists alone."""
    return _cube(_point_sizes(points))


def _point_sizes(points: DataFrame) -> DataFrame:
    return (
        points.select("point_id", name_key(F.col("datapoint_type")).alias("source"), code_column("lang").alias("lang"), "domain", unpadded_size(F.col("input_ids")).alias("n_tokens"))
        .groupBy("point_id").agg(F.max(F.struct("n_tokens", "source", "lang", "domain")).alias("_p"))
        .select(F.lit("training_datapoints").alias("record_table"), "_p.source", "_p.lang", "_p.domain", "_p.n_tokens")
    )


def _cube(sized: DataFrame) -> DataFrame:
    finest = sized.groupBy("record_table", "source", "lang", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return (
        finest.groupingSets([[F.col("record_table"), *[F.col(c) for c in some]] for some in _subsets("source", "lang", "domain")], "record_table", "source", "lang", "domain")
        .agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_records"), F.sum("t").alias("n_tokens"))
        .select("record_table", "source", "lang", "domain", "level", "n_records", "n_tokens")
    )


def _subsets(*names: str) -> list[list[str]]:
    return [[n for i, n in enumerate(names) if not mask >> (len(names) - 1 - i) & 1] for mask in range(1 << len(names))]
