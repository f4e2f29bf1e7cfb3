"""Packs that run over the borders of id blocks."""

import random

import pytest
from pyspark.sql import functions as F
from weftline.operators import order
from weftline.plans import catalog, corpus, files

QUERIES = catalog.queries()


@pytest.mark.parametrize("name", ["q32_sequence_packing", "q95_stream_pack"])
def test_packs_run_over_block_borders(name, spark, data, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in QUERIES[name](spark, data).drop("block").collect())
    whole = rows()
    monkeypatch.setattr(corpus, "PACK_BLOCK", 16)
    monkeypatch.setattr(files, "PACK_BLOCK", 16)
    assert rows() == whole


def test_chained_blocks_equal_one_fold(spark):
    random.seed(4)
    sizes = lambda k: random.choice([[0, 0, 1], [1, 2, 3], [0, 5, 40], [9, 10, 11]][k])
    df = spark.createDataFrame([(s, i, i // 7, sizes(s)) for s in range(4) for i in range(150)], "s int, id bigint, block bigint, n int")
    one = order.pack_greedily(df, "s", "id", F.col("n"), 10)
    chained = order.pack_greedily(df, "s", "id", F.col("n"), 10, block="block").drop("block")
    assert sorted(map(tuple, chained.collect())) == sorted(map(tuple, one.collect()))
