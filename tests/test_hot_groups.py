"""Few groups or labels of many rows are joined without dealing the rows by them."""

import pytest
from pyspark.sql import functions as F

from structlake.operators import evaluate, records


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _rows(spark):
    k = F.col("id")
    return spark.range(100_000).select(k.alias("label"), F.when(k % 10 > 0, "N").otherwise("A").alias("formula"), F.lit(2.0).alias("natoms"), k.cast("double").alias("target"), (k + 1.0).alias("pred"))


def _joins(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in text or "ShuffledHashJoin" in text, "BroadcastHashJoin" in text


def test_records_of_hot_labels_are_not_shuffled(spark, small_broadcasts):
    wanted = spark.createDataFrame([("N", 0), ("A", 1), ("none", 2), ("N", 3)], "formula string, pos int")
    of = records.select_by_label(_rows(spark), wanted, "formula", "pos", "label")
    assert _joins(of)[1]
    assert {(r.pos, r.label) for r in of.collect()} == {(0, 1), (1, 0), (3, 1)}


@pytest.mark.parametrize("join", [lambda rows: evaluate.relative_energies(rows), lambda rows: evaluate.r2_by_composition(rows), lambda rows: records.filter_group_threshold(rows, "formula", "target", 5.0)])
def test_rows_of_hot_formulas_are_not_shuffled(spark, small_broadcasts, join):
    got = join(_rows(spark))
    assert _joins(got) == (False, True) and got.count() > 1
