"""Quantiles by intervals against exact percentiles: ties, nulls, NaN, infinities, groups on both sides of the sketch's size."""

import pytest
from pyspark.sql import functions as F

from tidalframe import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.777, 0.95, 1.0]


@pytest.mark.parametrize("rows, accuracy", [(0, 10_000), (1, 10_000), (7, 10_000), (30_000, 1_000), (60_000, 10_000)])
def test_equals_percentiles(spark, monkeypatch, rows, accuracy):
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    i = F.col("id")
    key = F.when(i % 5 == 0, None).otherwise(F.least(i % 7, F.lit(2)))
    x = F.when(i % 11 == 3, None).when(i % 1009 == 8, float("nan")).when(i % 997 == 5, float("-inf")).when(i % 2 == 0, F.xxhash64("id") % 50 / 8).otherwise(F.xxhash64("id") % 1_000_003 / 7)
    df = spark.range(rows).select(key.alias("k"), F.lit("a").alias("q"), x.alias("x"))
    got = {r["k"]: r["of"] for r in q.quantiles(df, ["k", "q"], "x", PROBS, "of").collect()}
    want = {r["k"]: r["of"] for r in df.where("x is not null").groupBy("k").agg(F.percentile("x", PROBS).alias("of")).collect()}
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))


def test_rows_keep_their_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["m"] for r in q.with_quantiles(df, ["k"], "x", [0.5], "m").collect()}
    assert got == {("a", 1.0): [2.0], ("a", 3.0): [2.0], ("b", None): None, (None, 5.0): [5.0]}
    low = q.with_quantiles(df, ["k"], "x", [0.5], "m", only=F.col("x") < 2)
    assert {(r["k"], r["x"]): r["m"] for r in low.collect()}["a", 3.0] == [1.0]
