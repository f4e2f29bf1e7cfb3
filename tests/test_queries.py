"""Every query of the core against its SQL twin, and its independence of partitioning."""

import pytest
from oracle_check import compare
from weftline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


#: Iterative queries, held against a fit in numpy (test_probes.py).
WITHOUT_SQL = {"q117_softmax_probe"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_equals_sql(name, spark, data, duck):
    assert name in SQL
    assert compare(spark, duck, data, QUERIES[name], SQL[name]) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["ds_label", "n", "correct", "accuracy", "se", "lo", "hi"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["q03_length_grouped_order", "q12_balanced_downsample", "q31_stream_interleave", "q17_conj_disj"])
def test_result_does_not_depend_on_partitioning(name, spark, data):
    def rows():
        return sorted(map(repr, QUERIES[name](spark, data).collect()))

    first = rows()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
