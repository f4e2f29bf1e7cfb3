"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, writers


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def test_blank_lines_are_skipped(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, p, "a int").count() == 2
    assert [r["a"] for r in readers.json_lines_slice(spark, p, "a int", order="a", start=1, limit=1).collect()] == [2]
    assert readers.json_array(spark, None, "a int").count() == 0


@pytest.mark.parametrize("wrap", ["data", "records", "examples", None])
def test_records_are_unwrapped(spark, tmp_path, wrap):
    rows = [{"a": 1}, {"a": 2}]
    p = put(tmp_path / "x.json", json.dumps({wrap: rows} if wrap else rows))
    assert sorted(r["a"] for r in readers.json_records(spark, p, "a int").collect()) == [1, 2]


def test_relations_and_maps(spark, tmp_path):
    put(tmp_path / "r" / "capital.json", json.dumps({"name": "c", "prompt_templates": ["{} has {}"], "samples": [{"subject": "a", "object": "b"}, {"subject": "c", "object": "d"}]}))
    rows = readers.relation_folder(spark, str(tmp_path / "r" / "*.json")).collect()
    assert sorted((r["relation"], r["subject"], r["object"]) for r in rows) == [("capital", "a", "b"), ("capital", "c", "d")]
    p = put(tmp_path / "m.json", json.dumps({"goal": [["q", "a"]], "tone": []}))
    assert {r["label"]: r["value"] for r in readers.json_map(spark, p).collect()} == {"goal": [["q", "a"]], "tone": []}


def test_escaped_csv_and_list_tsv(spark, tmp_path):
    p = put(tmp_path / "e.csv", b'a,b\ncaf\\xe9,"x, y"\n')
    assert [tuple(r) for r in readers.csv_unicode_escape(spark, p, ["a", "b"]).collect()] == [("café", "x, y")]
    p = put(tmp_path / "t.tsv", "a\tl\n1\t['x', 'y']\n")
    assert [tuple(r) for r in readers.tsv_with_lists(spark, p, ["a", "l"], ["l"]).collect()] == [("1", ["x", "y"])]
    p = put(tmp_path / "w.csv", "Step,r1 - train/loss,r1 - train/loss__MIN\n1,0.5,0.4\n2,,0.1\n")
    assert [tuple(r) for r in readers.wide_metrics(spark, p, "Step").collect()] == [(1, "r1 - train/loss", 0.5)]


def test_result_files_are_chosen_by_name(spark, tmp_path):
    for name in ("a_keep.json", "a_skip.json", "b.json"):
        put(tmp_path / "res" / name, '{"v": 1}')
    rows = readers.result_folder(spark, str(tmp_path / "res" / "*.json"), "v int", include=["a_"], exclude=["skip"]).collect()
    assert [r["file"] for r in rows] == ["a_keep.json"]


def test_runs_need_their_sibling(spark, tmp_path):
    put(tmp_path / "runs" / "x_mi5__run2" / "grade.json", "{}")
    put(tmp_path / "runs" / "x_mi5__run2" / "stats.json", "{}")
    put(tmp_path / "runs" / "y_mi0__run1" / "grade.json", "{}")
    rows = readers.discover_runs(spark, str(tmp_path / "runs"), "grade.json", "stats.json", r"_mi\d+").collect()
    assert [(r["mi"], r["run"]) for r in rows] == [(5, 2)]
    assert readers.existing_files(spark, str(tmp_path / "runs"), "grade.json").count() == 2


def test_first_source_that_loads(spark, tmp_path):
    p = put(tmp_path / "l.txt", " a \n\nb")
    df = readers.first_that_loads(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: readers.lines(spark, p))
    assert sorted(r["line"] for r in df.collect()) == ["a", "b"]
    assert readers.first_that_loads(lambda: spark.read.parquet(str(tmp_path / "none"))) is None


def test_config_name_leaves_out_the_batch_size():
    a = writers.config_name({"dataset_name": "x/y", "batch_size": 1, "n": 2}, "train")
    assert a == writers.config_name({"n": 2, "dataset_name": "x/y", "batch_size": 8}, "train")
    assert a != writers.config_name({"n": 3, "dataset_name": "x/y"}, "train")
    assert a.startswith("x_y_train_")


def test_cached_dataset_is_made_once(spark, tmp_path):
    made = []

    def create():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.cached_dataset(spark, str(tmp_path), {"dataset_name": "r"}, "train", create).count() == 3
    assert made == [1]


def test_writers_append_refuse_and_migrate(spark, tmp_path):
    p, df = str(tmp_path / "j"), spark.createDataFrame([(1, "x")], "a int, old string")
    writers.json_lines(df, p, refuse=True)
    with pytest.raises(Exception, match="exists"):
        writers.json_lines(df, p, refuse=True)
    writers.json_lines(df, p, append=True)
    assert spark.read.json(p).count() == 2
    moved = writers.migrate(spark, p, str(tmp_path / "k"), "a int, old string, new string", {"old": "new"})
    assert {(r["a"], r["new"]) for r in moved.collect()} == {(1, "x")}
    writers.kept_rows(spark.createDataFrame([(0.9,), (0.5,)], "f1 double"), F.col("f1") > 0.8, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1


def test_weights_are_renamed_and_checked(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0])], "i int, `decoder.weight` array<double>").withColumnRenamed("decoder.weight", "dec").write.parquet(str(tmp_path / "w"))
    rows, bad = readers.weights(spark, str(tmp_path / "w"), {"dec": "w_dec"})
    assert rows.columns == ["i", "w_dec"]
    assert [r["i"] for r in bad.collect()] == [1]


def test_configs_come_back(spark, tmp_path):
    from weftline.sources import config

    p = str(tmp_path / "c.yaml")
    config.save(spark, {"a": 1}, p)
    config.save(spark, {"a": 1, "b": ["x"]}, p)
    assert config.load(spark, p) == {"a": 1, "b": ["x"]}
    assert config.problems({"a": 1, "z": 2}, {"a", "b"}, {"a", "b"}) == ["missing: b", "unknown: z"]


def test_run_trees_are_flattened(spark, tmp_path):
    for name, score in (("m_mi5__run2", 4), ("m_mi0__run1", 2)):
        put(tmp_path / "t" / name / "hypothesis_grade.json", json.dumps({"score": score, "grade": "ok"}))
        put(tmp_path / "t" / name / "description.txt", " text \n")
    put(tmp_path / "t" / "m_mi9__run9" / "hypothesis_grade.json", "{}")
    rows = writers.flatten_runs(spark, str(tmp_path / "t"), str(tmp_path / "runs.jsonl")).collect()
    assert sorted((r["mi"], r["run_idx"], r["score"], r["grade"]) for r in rows) == [(0, 1, 2, "ok"), (5, 2, 4, "ok")]
    assert spark.read.json(str(tmp_path / "runs.jsonl")).count() == 2


def test_metrics_sink_appends(spark, tmp_path):
    from weftline.streaming import jobs

    spark.createDataFrame([(1, 0.5), (2, 0.25)], "step int, loss double").write.parquet(str(tmp_path / "in" / "m.parquet"))
    jobs.metrics_sink(jobs.table_stream(spark, str(tmp_path / "in"), "m"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("step", "loss").collect()) == [(1, 0.5), (2, 0.25)]
