"""Probes against fits in numpy, and functions and joins of features on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import sequences as seq
from weftline.operators import cache, joins, probes
from weftline.sources.readers import image_paths


def fitted(x, y, train, decay=1e-4, steps=4000):
    """A softmax probe by plain gradient descent on standardized vectors."""
    z = (x - x[train].mean(0)) / np.maximum(x[train].std(0), 1e-6)
    k = y.max() + 1
    w, b = np.zeros((z.shape[1], k)), np.zeros(k)
    for _ in range(steps):
        e = np.exp(z[train] @ w + b - (z[train] @ w + b).max(1, keepdims=True))
        g = e / e.sum(1, keepdims=True) - np.eye(k)[y[train]]
        w -= 0.5 * (z[train].T @ g / train.sum() + decay * w)
        b -= 0.5 * g.mean(0)
    return (z @ w + b).argmax(1)


def test_probe_equals_a_fit_in_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 5)) + 1.2 * np.eye(5)[y]
    train = np.arange(400) % 4 != 0
    df = spark.createDataFrame([(i, a.tolist(), "abc"[b], bool(t)) for i, (a, b, t) in enumerate(zip(x, y, train, strict=True))] + [(900, None, "a", True), (901, [0.0] * 5, None, False)], "id int, v array<double>, label string, is_train boolean")
    got = {r["id"]: int(r["guess"]) for r in probes.softmax_probe(df, "v", "label", "is_train", iterations=200).collect()}
    want = fitted(x, y, train)
    assert len(got) == 400
    assert np.mean([got[i] == want[i] for i in range(400)]) > 0.99


def test_unseen_label_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.0], "a", True), (2, [1.0], "b", True), (3, [1.0], "c", False)], "id int, v array<double>, label string, is_train boolean")
    with pytest.raises(Exception, match="not among the training labels"):
        probes.softmax_probe(df, "v", "label", "is_train").collect()


def test_standardized_by_training_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0], True), (2, [2.0, 5.0], True), (3, [4.0, 6.0], False), (4, None, False)], "id int, v array<double>, t boolean")
    z = {r["id"]: r["z"] for r in probes.standardized(df, "v", "t").collect()}
    assert z[1] == [-1.0, 0.0]
    assert z[3][0] == 3.0
    assert z[3][1] == pytest.approx(1e6)
    assert z[4] is None


def test_query_of_the_probe(spark, data):
    from weftline.plans import catalog

    rows = {r["is_train"]: r for r in catalog.queries()["q117_softmax_probe"](spark, data).collect()}
    assert rows[True]["n"] > rows[False]["n"] > 0
    assert rows[True]["accuracy"] > 0.2


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def test_special_ids(spark):
    ids = ints(1, 7, 0, None, 2, 9)
    assert one(spark, seq.special_mask(ids, 1, 2, None)) == [True, False, False, False, True, False]
    assert one(spark, seq.without_special(ids, 1, 2, 0)) == [7, None, 9]
    assert one(spark, seq.without_special(ids)) == [1, 7, 0, None, 2, 9]
    assert one(spark, seq.special_mask(ids, None)) == [False] * 6


def test_prefixes_ranges_and_windows(spark):
    assert [one(spark, seq.label_prefix(F.lit(x))) for x in ("a-b-c", "abc", "", None)] == ["a", "abc", "", ""]
    span = lambda a, b, n: tuple(one(spark, seq.absolute_range(F.lit(a), F.lit(b), F.lit(n))))
    assert span(-3, 10, 10) == (7, 10, True)
    assert span(-11, 10, 10)[2] is False
    assert span(4, 4, 10)[2] is False
    assert span(0, 11, 10)[2] is False
    window = lambda n, o, k: tuple(one(spark, seq.image_window(F.lit(n), F.lit(o), F.lit(k))))
    assert window(10, -2, 3) == (6, 8)
    assert window(10, -2, 99) == (0, 8)
    assert window(1, -1, 5) == (0, 1)  # never before place 1, as the guard has it


def test_image_parts(spark):
    kind = "array<struct<type:string,text:string,image:string,path:string>>"
    df = spark.createDataFrame([([("image", None, "a.jpg", None), ("text", "t", "no", None), ("image", None, None, "b.png"), ("image", None, None, None)],), (None,)], f"c {kind}")
    assert [r[0] for r in df.select(image_paths(F.col("c"))).collect()] == [["a.jpg", "b.png"], None]


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "at int, k string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "at int, k string")
    assert tuple(joins.aligned(a, b, "k", "k", "at").collect()[0]) == (3, 4, 3, 1)
    assert joins.checked(joins.aligned(a, a, "k", "k", "at")).count() == 1
    with pytest.raises(Exception, match="keys differ at 1 places"):
        joins.checked(joins.aligned(a, b, "k", "k", "at")).collect()


def test_responses_keep_their_order(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in (5, 3, 9, 1)], "id int, p string")
    rows = cache.respond_in_order(df, "p", "id", lambda s: s.str.upper(), parallel=3).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["response"]) for r in rows] == [(0, "P1"), (1, "P3"), (2, "P5"), (3, "P9")]


def test_max_activations_are_read(spark, tmp_path):
    from weftline.sources.readers import max_activations

    spark.createDataFrame([(1, 0, ["a", "b"], [0.5, 2.0])], "feature bigint, rank int, tokens array<string>, acts array<double>").write.parquet(str(tmp_path / "m"))
    assert tuple(max_activations(spark, str(tmp_path / "m")).collect()[0]) == (1, 0, ["a", "b"], [0.5, 2.0])


def test_ranks_by_value_withstand_outliers(spark):
    from weftline.ranks import medians, value_at_rank, value_rank, lower_median

    rows = [(i, float(v)) for i, v in enumerate([1e15, -1e15, *[0.001 * j for j in range(500)], *[7.0] * 50])] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = [r["id"] for r in value_rank(df, "v", "id").orderBy("rank").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    down = [r["id"] for r in value_rank(df, "v", "id", descending=True).orderBy("rank").collect()]
    assert down == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    values = sorted(v for _, v in rows if v is not None)
    assert value_at_rank(df, "v", lower_median(), continuous=True).collect()[0]["value"] == values[(len(values) - 1) // 2]
    grouped = df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = {r["g"]: r["median"] for r in medians(grouped, "v", ["g"]).collect()}
    for g in (None, 1, 2):
        assert got[g] == pytest.approx(float(np.median([v for i, v in rows if v is not None and (i % 3 or None) == g])))
    assert value_rank(df.limit(0), "v", "id").count() == 0
    assert value_at_rank(df.limit(0), "v", lower_median(), continuous=True).count() == 0


def test_steps_are_refused_without_a_shared_folder():
    from types import SimpleNamespace

    from weftline import storage

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(cluster)
    assert storage.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[8]"))).startswith("file://")
