"""Shapes of physical plans: pruned scans, expressions that stay in the JVM, no pairs of rows by products."""

import re

import pytest
from weftline.plans import catalog

QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "read", "unread"),
    [
        ("q01_corpus_stats", {"text", "source"}, {"domain", "created_at", "n_chars"}),
        ("q11_binary_label_qa", {"sample_id", "context", "questions", "answers"}, {"ds_label", "split"}),
        ("q12_balanced_downsample", {"sample_id", "ds_label"}, {"context", "questions"}),
        ("q61_binomial_ci", {"datapoint_id", "dataset_name", "target_response"}, {"activation_prompt"}),
        ("q70_conditional_pivot", {"o_orderpriority", "o_orderstatus", "o_totalprice"}, {"o_orderdate"}),
    ],
)
def test_scans_read_only_what_is_used(name, read, unread, spark, data):
    text = plan(QUERIES[name](spark, data))
    columns = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^\n]*)>", text))))
    assert read <= columns
    assert not unread & columns


@pytest.mark.parametrize(("name", "filtered"), [("q07_longest_rows", "IsNotNull(source)"), ("q02_percentile_trim", "IsNotNull(text)"), ("q69_precision_recall_f1", "vec_id")])
def test_filters_reach_the_scan(name, filtered, spark, data):
    assert filtered in plan(QUERIES[name](spark, data))


PYTHON = {
    "q50_cosine_topk", "q57_hard_negatives", "q75_request_cache", "q95_stream_pack", "q97_stream_mix", "q109_stream_sessions", "q110_sliding_windows", "q116_inactive_neighbours", "q117_softmax_probe", "q125_ordered_responses",
    "q56_probe_centroid", "q129_sentence_table", "q127_reader_shapes", "q128_writer_shapes",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - {n for n in QUERIES if n[:3] in ("q94", "q96", "q98")}))
def test_expressions_stay_in_the_jvm(name, spark, data):
    text = plan(QUERIES[name](spark, data))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups", text)
    assert "CartesianProduct" not in text
