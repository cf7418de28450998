"""Augmented Dickey-Fuller tests against least squares on whole series."""

import math

import numpy as np
import pandas as pd
import pytest

from tidalframe.operators import stationary


def plain(y):
    """statistic, lags, rows by least squares on every number of lags."""
    most, aic = stationary.most_lags(len(y)), []

    def fit(lags, skip):
        d = np.diff(y)
        rows = range(skip, len(d))
        x = np.array([[y[t], 1.0, *(d[t - k] for k in range(1, lags + 1))] for t in rows])
        v = np.array([d[t] for t in rows])
        beta, *_ = np.linalg.lstsq(x, v, rcond=None)
        e = v - x @ beta
        return x, beta, float(e @ e), len(v)

    for lags in range(most + 1):
        _, _, ssr, n = fit(lags, most)
        aic.append(n * math.log(ssr / n) + 2 * (lags + 2))
    lags = int(np.argmin(aic))
    x, beta, ssr, n = fit(lags, lags)
    return beta[0] / math.sqrt(ssr / (n - lags - 2) * np.linalg.inv(x.T @ x)[0, 0]), lags, n


def test_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=700)
    ar = np.zeros(700)
    for t in range(2, 700):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + e[t]
    t = pd.date_range("2024-01-01", periods=700, freq="min")
    p = pd.concat([pd.DataFrame({"symbol": "a", "datetime": t, "x": 1000 + ar, "walk": np.cumsum(e)}), pd.DataFrame({"symbol": "b", "datetime": t[:90], "x": np.cumsum(e[:90]), "walk": 1.0}), pd.DataFrame({"symbol": "c", "datetime": t[:50], "x": e[:50], "walk": e[:50]})])
    p.iloc[5, 2] = np.nan
    for rows in (65_536, 100):
        got = {(r.symbol, r["name"]): r for r in stationary.dickey_fuller(spark.createDataFrame(p), ["x", "walk"], rows).collect()}
        assert got.keys() == {("a", "x"), ("a", "walk"), ("b", "x")}
        for (symbol, name), r in got.items():
            y = p[p.symbol == symbol][name].dropna().to_numpy()
            tau, lags, n = plain(y)
            assert (r.lags, r.n) == (lags, n) and r.statistic == pytest.approx(tau, rel=1e-6)
            assert r.stationary == (r.p_value < 0.05) == (r.statistic < r.critical_5)
        assert got["a", "x"].stationary and not got["b", "x"].stationary


def test_p_values_agree_with_critical_values():
    for tau, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert stationary.p_value(tau) == pytest.approx(p, abs=0.002)
    assert stationary.p_value(-30.0) == 0.0 and stationary.p_value(5.0) == 1.0 and stationary.p_value(0.0) > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "symbol string, datetime timestamp_ntz, x double")
    assert stationary.dickey_fuller(df, ["x"]).count() == 0
