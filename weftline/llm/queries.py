"""Queries p1_ to p8_ over the project's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import table


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from weftline.llm.sampling import proportional_sample

    pool = (
        table(spark, d, "context_qa_samples").select(F.lit("context_qa_samples").alias("pool"), F.col("sample_id").alias("record_id"), "ds_label")
        .unionByName(table(spark, d, "classification_datapoints").select(F.lit("classification_datapoints").alias("pool"), F.col("datapoint_id").alias("record_id"), "ds_label"))
    )
    return proportional_sample(pool, table(spark, d, "sampling_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("shortfall > 0").select("target_set", "category")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def _mixed(spark: SparkSession, d: str, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    from weftline.llm.encoding import unpadded_size
    from weftline.llm.mixing import mix_sources

    records = table(spark, d, "training_datapoints")
    if size:
        records = records.select("point_id", "datapoint_type", unpadded_size(F.col("input_ids")).alias(size))
    return mix_sources(records, table(spark, d, "mix_targets"), table(spark, d, "dataset_loader_configs"), size=size)


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({c: F.round(c, 9) for c in ("expected", "share", "deviation")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("capacity < wanted").select("mix_id", "dataset_name")


def p2_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select("mix_id", "dataset_name", F.col("record_id").alias("point_id"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_mixed(spark, d)[1].drop("size_drawn"))


def p2_token_shares(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_mixed(spark, d, "n_tokens")[1])


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.encoding import token_budget

    return token_budget(table(spark, d, "documents"), table(spark, d, "training_datapoints"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.encoding import token_counts

    return token_counts(table(spark, d, "documents"), keep=["doc_id"])


def p3_point_counts(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.encoding import unpadded_size

    points = table(spark, d, "training_datapoints").select("point_id", unpadded_size(F.col("input_ids")).alias("n_tokens"))
    return points.groupBy("point_id").agg(F.max("n_tokens").alias("n_tokens"))


def p3_point_budget(spark: SparkSession, d: str) -> DataFrame:
    """The half of p3_budget that SQL can state: token lists."""
    from weftline.llm.encoding import point_budget

    return point_budget(table(spark, d, "training_datapoints"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.overlap import cross_split_pairs

    pairs = cross_split_pairs(table(spark, d, "context_qa_samples"))
    return pairs.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.overlap import cross_split_links, overlap_report

    samples = table(spark, d, "context_qa_samples")
    return overlap_report(samples, *cross_split_links(samples))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.pairs import defective_pairs, pairs_of_dialogs, pairs_of_results

    dialogs = pairs_of_dialogs(table(spark, d, "latentqa_datapoints")).withColumn("record_table", F.lit("latentqa_datapoints"))
    results = pairs_of_results(table(spark, d, "verbalizer_results")).withColumn("record_table", F.lit("verbalizer_results"))
    return defective_pairs(dialogs.unionByName(results))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.encoding import encode_texts

    return encode_texts(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.packing import pack_texts

    return pack_texts(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p7_waste(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs").select("spec_id", "capacity_tokens")
    filled = p7_pack(spark, d).groupBy("spec_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("container_id").alias("n_containers"))
    return filled.join(specs, "spec_id").withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """What p7_pack must keep: every text once for each spec, and no container beyond its capacity."""
    packed = p7_pack(spark, d)
    filled = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("filled")).join(table(spark, d, "container_specs").select("spec_id", "capacity_tokens"), "spec_id")
    over = filled.groupBy("spec_id").agg(F.count_if(F.col("filled") > F.col("capacity_tokens")).alias("n_overfull"))
    return packed.where("piece = 0").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_distinct("doc_id").alias("n_ids")).join(over, "spec_id")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document, with a language and a confidence or with neither."""
    found = p8_languages(spark, d)
    bad = F.col("language").isNull() != F.col("confidence").isNull()
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(bad).alias("n_halves"), F.count_if(~F.col("confidence").between(0, 1)).alias("n_outside"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.langid import fit_once, label_languages

    documents = table(spark, d, "documents")
    return label_languages(documents, fit_once(documents))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.langid import language_defects

    return language_defects(_labelled(spark, d))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("doc_id", "language", "confidence", "n_words")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = _labelled(spark, d).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return segments.select("doc_id", "segment_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][1:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from weftline.llm import oracle

    return oracle.sql()
