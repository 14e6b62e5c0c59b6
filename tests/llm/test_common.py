"""Joins on hot keys and the tables that go with their scope."""

import os

import pytest
from pyspark.sql import functions as F

from tarn.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_one(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, f"k{i % 2}", i) for i in range(900)], "a int, b string, i int")
    right = spark.createDataFrame([(1, "k0", 7), (1, "k1", 8), (1, "k1", 9), (30, "k0", 3), (5000, "k0", 1)], "a int, b string, v int")
    hot = common.hot_keys(left, ["a", "b"])
    assert {(r["a"], r["b"]) for r in hot.collect()} == {(1, "k0"), (1, "k1")} and all(r["salts"] >= 2 for r in hot.collect())
    got = common.salted_join(left, right, ["a", "b"], ["i"], how, hot)
    want = left.join(right, ["a", "b"], how)
    assert sorted(map(str, got.select("a", "b", "i", "v").collect())) == sorted(map(str, want.select("a", "b", "i", "v").collect()))
    sized = left.groupBy("a", "b").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, common.hot_keys(sized, ["a", "b"], "n").collect())) == sorted(map(tuple, hot.collect()))
    assert common.hot_keys(left.limit(0), ["a"]) is None and common.hot_keys(left.where("a <> 1"), ["a"]) is None


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        inner = common.written(spark.range(3), "inner")
        with common.scratch(spark):
            deeper = common.written(spark.range(2), "deeper")
            kept = common.written(deeper.unionByName(inner), "kept", keep=True)
        assert inner.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    base = path.split("/kept-")[0]
    assert not [d for d in os.listdir(base) if d.startswith("scratch-")]
