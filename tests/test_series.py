"""Blocks: whatever their size, windows and scans give the whole series' values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe import series
from tidalframe.functions import arrays, price, recursive, volatility
from tidalframe.operators import clean, labels, resample, splits


def walk(n: int, seed: int = 42, symbols=("A", "B")) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for k, s in enumerate(symbols):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        o = np.concatenate([[c[0]], c[:-1]])
        out.append(pd.DataFrame({"symbol": s, "datetime": pd.date_range("2024-01-01", periods=n, freq=f"{7 + k}min"), "open": o, "high": np.maximum(o, c) * 1.001, "low": np.minimum(o, c) * 0.999, "close": c, "volume": rng.integers(1, 100, n)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(700)).withColumn("datetime", F.col("datetime").cast("timestamp_ntz")).cache()


def test_index_equals_row_number(spark, bars):
    got = series.indexed(bars).select("symbol", "datetime", "_idx").toPandas().sort_values(["symbol", "datetime"])
    assert got.groupby("symbol")._idx.apply(list).map(lambda x: x == list(range(700))).all()


@pytest.mark.parametrize("size", [97, 10_000])
def test_features_do_not_depend_on_blocks(bars, monkeypatch, size):
    def run(rows):
        monkeypatch.setattr(series, "BLOCK_ROWS", rows)
        monkeypatch.setattr(series.blocked, "__defaults__", (0, rows))
        r = series.Rolling.of_blocks()
        f = series.with_features(bars, price.sma(r) | price.cci(r) | volatility.bollinger(r) | volatility.microstructure(r), 202)
        ind = recursive.indicators(bars)
        lab = labels.triple_barrier(f.withColumn("atr_14", F.col("bb_upper") - F.col("bb_lower")), 5, 0.3, 0.3, 15)
        parts = [x.toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True) for x in (f, ind, lab)]
        return parts

    for a, b in zip(run(size), run(1_000_000), strict=True):
        assert len(a) == 1400
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_recursive_filters_equal_plain_loops():
    x = walk(300).close.to_numpy()[:300]
    e = pd.Series(x).ewm(span=12, adjust=False, min_periods=12).mean().to_numpy()
    np.testing.assert_allclose(recursive.ewm(x, 12), e)
    seeded = recursive.ema(x, 12)
    assert np.isnan(seeded[:11]).all() and seeded[11] == pytest.approx(x[:12].mean())
    assert (recursive.rsi(np.arange(30.0) + 1)[14:] == 100).all()
    assert np.isnan(recursive.atr(x[:10], x[:10], x[:10], 14)).all()
    gap = x.copy()
    gap[40] = np.nan
    assert recursive.ema(gap, 9)[40] == recursive.ema(gap, 9)[39]


def test_dwt_keeps_energy_of_constant_and_linear_signals():
    flat = np.full((2, 64), 3.0)
    a, *d = arrays.wavedec(flat, 3)
    assert np.allclose(a, 3.0 * 2**1.5) and all(np.abs(x).max() < 1e-9 for x in d)
    ramp = np.arange(64.0)[None]
    inner = arrays.dwt(ramp)[1][:, 4:-4]
    assert np.abs(inner).max() < 1e-9


def test_hurst_of_trending_and_reverting_prices():
    rng = np.random.default_rng(0)
    steps = rng.normal(0, 0.01, (50, 200))
    trend = np.exp(np.cumsum(np.cumsum(steps, 1) * 0.2, 1))
    back = np.exp(steps)
    assert np.nanmean(arrays.hurst_rows(trend)) > 0.8 > 0.6 > np.nanmean(arrays.hurst_rows(back))


def test_lookahead_does_not_move_past_features(spark, bars):
    r = series.Rolling.of_blocks()
    feats = price.returns(r) | price.stochastic(r) | volatility.parkinson(r)
    jump = bars.withColumn("close", F.when(F.col("datetime") == F.lit("2024-01-02 00:04:00").cast("timestamp_ntz"), F.col("close") * 2).otherwise(F.col("close")))
    a, b = (series.with_features(x, feats, 62, keep=["symbol", "datetime"]).where("datetime <= TIMESTAMP_NTZ '2024-01-02 00:04:00'").toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True) for x in (bars, jump))
    pd.testing.assert_frame_equal(a, b)


def micro(spark, highs, lows, atr=2.0, opens=None):
    n = len(highs)
    atr = [atr] * n
    return spark.createDataFrame(pd.DataFrame({"symbol": "X", "datetime": pd.date_range("2024-01-01", periods=n, freq="5min"), "open": opens or [100.0] * n, "high": highs, "low": lows, "close": [100.0] * n, "volume": 1, "atr_14": atr}), "symbol string, datetime timestamp, open double, high double, low double, close double, volume int, atr_14 double")


def test_barrier_hits_timeouts_and_double_hits(spark):
    flat = [100.0] * 20
    up, down, both = list(flat), list(flat), (list(flat), list(flat))
    up[3], down[3] = 105.0, 95.0
    both[0][3], both[1][3] = 105.0, 95.0
    label = lambda h, low, **k: [r["label_h5"] for r in labels.triple_barrier(micro(spark, h, low, **k), 5, 1.0, 1.0, 5).orderBy("datetime").collect()]
    assert label(up, flat)[:4] == [1, 1, 1, 0] and label(flat, down)[:3] == [-1, -1, -1] and label(*both)[:3] == [-99, -99, -99]
    assert label(up, flat)[-5:] == [-99] * 5 and label(up, flat, atr=0.0)[:3] == [0, 0, 0]
    opens = [100.0] * 20
    opens[3] = 101.0
    d = micro(spark, *both, opens=opens)
    assert [r["label_h5"] for r in labels.threshold(d, 5, 0.02, 0.02, 5).orderBy("datetime").collect()][:3] == [1, 1, 1]


def test_cleaning_of_dirty_rows(spark):
    rows = [("A", "2024-01-01 00:00:00", "1", "2", "0.5", "1.5", "7"), ("A", "2024-01-01 00:01:00", "1", "0.5", "2", "1.5", "-3"), ("A", "2024-01-01 00:02:00", "0", "2", "0.5", "1", "1"), ("A", "2024-01-01 00:03:00", "x", "2", "0.5", "1", "1"), ("A", "2024-01-01 00:09:00", "1", "2", "1", "1", None)]
    df = clean.standardise(spark.createDataFrame(rows, "symbol string, Timestamp string, O string, H string, L string, C string, Vol string"))
    assert df.columns == ["symbol", "datetime", "open", "high", "low", "close", "volume"]
    c = clean.coerce(df)
    assert c.count() == 4 and [r["volume"] for r in c.orderBy("datetime").collect()] == [7, -3, 1, 0]
    fixed = clean.repair(c).orderBy("datetime").collect()
    assert len(fixed) == 3 and all(r["high"] >= r["low"] for r in fixed) and fixed[1]["volume"] == 0
    filled = clean.fill_simple(clean.repair(c), 1, 3).orderBy("datetime").collect()
    assert [r["missing_bar"] for r in filled] == [0, 0, 1, 1, 1, 0]
    line = clean.interpolate(spark.createDataFrame([("A", f"2024-01-01 00:0{i}:00", x) for i, x in enumerate([1.0, None, None, 4.0])], "symbol string, datetime string, x double").withColumn("datetime", F.col("datetime").cast("timestamp_ntz")), "x", 1)
    assert [r["x"] for r in line.orderBy("datetime").collect()] == [1.0, 2.0, None, 4.0]
    with pytest.raises(ValueError):
        clean.standardise(df.withColumn("dt", F.lit(1)))


def test_bars_and_splits_edges(spark, bars):
    with pytest.raises(ValueError):
        resample.build_bars(bars, "tick")
    with pytest.raises(ValueError):
        splits.bounds(100)
    v = resample.volume_bars(bars, 500.0).orderBy("symbol", "bar_id").toPandas()
    assert v.n_bars.sum() == 1400 and (v.groupby("symbol").volume.apply(lambda x: (x[:-1] >= 500).all())).all()
    seq = splits.sequences(bars, ["open", "close"], 5)
    assert seq.count() == 2 * 696 and np.array(seq.first()["sequence"]).shape == (5, 2)
