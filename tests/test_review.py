"""Checks before training: what they refuse, and rounding."""

import pytest
from pyspark.sql import functions as F

from tidalframe import plans
from tidalframe.operators import clean, review


def test_presets_round_to_two_digits(spark, sf):
    m = dict(review.PRESETS)
    rows = {(r["preset"], r["symbol"], r["horizon"]): r for r in plans.QUERIES["preset_barriers"](spark, sf).collect()}
    base = {(r["symbol"], r["horizon"]): r for r in plans.QUERIES["barrier_lookup"](spark, sf).collect()}
    for (preset, symbol, horizon), r in rows.items():
        b = base[(symbol, horizon)]
        assert abs(r["k_up"] - b["k_up"] * m[preset]) <= 0.005 + 1e-9 and r["max_bars"] == b["max_bars"]


def test_labels_and_frames_outside_the_domain_are_refused(spark):
    df = spark.createDataFrame([(2,)], "l int")
    with pytest.raises(Exception, match="no label"):
        df.select(review.class_of(F.col("l"))).collect()
    with pytest.raises(ValueError):
        review.resampling_info("15min", "5min")
    with pytest.raises(ValueError):
        review.resampling_info("4h", "5h")


def test_interpolation_of_long_runs_and_fill(spark):
    rows = [("a", f"2024-01-0{2 + k // 24} {k % 24:02d}:00:00", float(k) if k in (0, 40) else None) for k in range(48)]
    df = spark.createDataFrame(rows, "symbol string, t string, close double").select("symbol", F.col("t").cast("timestamp_ntz").alias("datetime"), "close")
    got = [r["close"] for r in clean.interpolate(df, "close", 2).orderBy("datetime").collect()]
    assert got[:4] == [0.0, 1.0, 2.0, None] and got[40] == 40.0 and got[41:] == [None] * 7 and got[3:40] == [None] * 37
    bars = spark.createDataFrame([("a", "2024-01-03 10:00:00", 1.0, 5), ("a", "2024-01-03 10:04:00", 3.0, 7)], "symbol string, t string, close double, volume long")
    bars = bars.select("symbol", F.col("t").cast("timestamp_ntz").alias("datetime"), "close", "volume")
    out = clean.fill(bars, limit=5, method="interpolate").orderBy("datetime").collect()
    assert [r["close"] for r in out] == [1.0, 1.5, 2.0, 2.5, 3.0] and [r["volume"] for r in out] == [5, 0, 0, 0, 7]


def test_splits_are_written_and_read_back(spark, tmp_path):
    from tidalframe.sources import files

    rows = [("a", i, ["train", "val", "test"][i % 3], float(i), -99 if i % 5 == 0 else i % 3 - 1) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, row_id long, split string, x double, label_h5 int")
    root = f"{tmp_path}/splits"
    known = {r["split"]: r["rows"] for r in files.save_splits(df, root, ["x"], "label_h5").collect()}
    assert known == {"train": 10, "val": 10, "test": 10}
    back = files.read_splits(spark, root, "label_h5", "val")
    assert {r["row_id"] for r in back.collect()} == {i for _, i, s, _, y in rows if s == "val" and y != -99}
    assert files.read_splits(spark, root, "label_h5", invalid=None).count() == 30
    files.save_stacking(df, str(tmp_path), 5, ["m0"])
    assert spark.read.parquet(f"{tmp_path}/stacking_h5").count() == 30


def test_alignment_wants_leading_nulls(spark):
    t = lambda k: f"2024-01-02 0{k}:00:00"
    rows = [("a", t(k), None if k < 2 else 1.0, 5.0) for k in range(6)]
    df = spark.createDataFrame(rows, "symbol string, t string, late double, early double").select("symbol", F.col("t").cast("timestamp_ntz").alias("datetime"), "late", "early")
    got = {r["name"]: (r["in_span"], r["first_null"], r["leading_nulls"]) for r in review.alignment_check(df, df, ["late", "early"]).collect()}
    assert got == {"late": (True, True, 2), "early": (True, False, 0)}
