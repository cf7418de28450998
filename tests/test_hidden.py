"""Hidden Markov regimes against a plain log-space version, in one block and over many."""

import numpy as np
import pandas as pd
import pytest

from tidalframe.operators import hidden


def lse(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def log_b(x, mean, var):
    return -0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var))


def plain_forward(x, pi, a, mean, var):
    b, out = log_b(x, mean, var), []
    al = np.log(pi) + b[0]
    out.append(al)
    for t in range(1, len(x)):
        al = lse(al[:, None] + np.log(a), 0) + b[t]
        out.append(al)
    return np.array(out)


def plain_fit(x, s):
    best = None
    for i in range(s.starts):
        draw = np.sort(np.random.default_rng(s.seed + i).normal(size=s.states))
        pi, a = np.full(s.states, 1 / s.states), np.full((s.states, s.states), 1 / s.states)
        mean, var = x.mean() + x.std() * draw, np.full(s.states, x.std() ** 2 + s.scatter / 10)
        before = -np.inf
        for _ in range(s.max_iter):
            al, b = plain_forward(x, pi, a, mean, var), log_b(x, mean, var)
            be = np.zeros_like(al)
            for t in range(len(x) - 2, -1, -1):
                be[t] = lse(np.log(a) + b[t + 1] + be[t + 1], 1)
            ll = lse(al[-1], 0)
            g = np.exp(al + be - ll)
            xi = sum(np.exp(al[t][:, None] + np.log(a) + b[t + 1] + be[t + 1] - ll) for t in range(len(x) - 1))
            n = g.sum(0)
            pi, a, mean = np.maximum(g[0], 1e-300), np.maximum(xi / xi.sum(1, keepdims=True), 1e-300), (g * x[:, None]).sum(0) / n
            var = ((g * x[:, None] ** 2).sum(0) - n * mean**2 + s.scatter) / n
            if ll - before < s.tol:
                break
            before = ll
        ll = lse(plain_forward(x, pi, a, mean, var)[-1], 0)
        if best is None or ll > best[0]:
            o = np.argsort(var)
            best = (ll, pi[o], a[np.ix_(o, o)], mean[o], var[o])
    return best[1:]


def plain_last(x, pi, a, mean, var):
    al = plain_forward(x, pi, a, mean, var)[-1]
    d, b = np.log(pi), log_b(x, mean, var)
    d = d + b[0]
    for t in range(1, len(x)):
        d = (d[:, None] + np.log(a)).max(0) + b[t]
    return int(np.argmax(d)), np.exp(al - lse(al, 0))


def plain_regimes(close, s):
    with np.errstate(all="ignore"):
        x = np.concatenate([[np.nan], np.where((close[1:] > 0) & (close[:-1] > 0), np.log(close[1:] / close[:-1]), np.nan)])
    out, model = [None] * len(close), None
    for i in range(s.first, len(close)):
        if (i - s.first) % s.every == 0:
            seen = x[: i + 1]
            seen = seen[~np.isnan(seen)]
            model = plain_fit(seen, s)
        else:
            seen = x[max(0, i - s.lookback) : i + 1]
            seen = seen[~np.isnan(seen)]
        out[i] = plain_last(seen, *model)
    return [None, *out[:-1]]


def series(seed, n):
    rng = np.random.default_rng(seed)
    calm = np.repeat(rng.integers(0, 2, n // 25 + 1), 25)[:n]
    return 100 * np.exp(np.cumsum(np.where(calm == 1, 0.3, 0.05) * rng.normal(size=n)))


@pytest.mark.parametrize("block", [65_536, 100])
def test_equals_a_plain_version(spark, block):
    s = hidden.Settings(states=2, lookback=60, every=90, starts=2, max_iter=5, block=block)
    rows, want = [], {}
    for symbol, seed, n in (("a", 1, 330), ("b", 2, 260), ("short", 3, 40)):
        close = series(seed, n)
        close[17] = 0.0
        rows += [(symbol, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), float(c)) for i, c in enumerate(close)]
        want[symbol] = plain_regimes(close, s)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "datetime", "close"]))
    got = hidden.regimes(df.repartition(3), s).orderBy("symbol", "datetime").toPandas()
    assert len(got) == len(rows)
    for symbol, w in want.items():
        g = got[got.symbol == symbol].reset_index(drop=True)
        for i, x in enumerate(w):
            if x is None:
                assert g.hmm_regime[i] is None and np.isnan(g.prob_state_0[i])
            else:
                assert g.hmm_regime[i] == s.labels[x[0]], (symbol, i)
                assert np.allclose([g.prob_state_0[i], g.prob_state_1[i]], x[1], atol=1e-6), (symbol, i)
        assert (symbol == "short") == g.hmm_regime.isna().all()


def test_block_products_are_associative():
    s = hidden.Settings(states=3, starts=2)
    x = np.random.default_rng(0).normal(size=90)
    m = hidden.begun(x.mean(), x.std(), s)
    ends = np.array([90, 70])
    whole, ll = hidden.forward(x, ends, m, m.start)[:2]
    v, total = m.start, np.zeros(2)
    for lo in range(0, 90, 30):
        v, part = hidden.forward(x[lo : lo + 30], np.clip(ends - lo, 0, 30), m, v)[:2]
        total = total + part
    assert np.allclose(v, whole) and np.allclose(total, ll)


def test_stretches_have_the_same_sums():
    s = hidden.Settings(states=3, starts=3)
    x = np.random.default_rng(1).normal(size=77)
    m = hidden.begun(x.mean(), x.std(), s)
    ends, more = np.array([77, 40, 9]), np.array([True, False, False])
    u = np.array([[0.3, 1.0, 0.5], [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]])
    for a, b in zip(hidden.sums(x, ends, more, m, m.start, u), hidden.stretched_sums(x, ends, more, m, m.start, u), strict=True):
        assert np.allclose(a, b)


def test_empty_and_named_states(spark):
    df = spark.createDataFrame([], "symbol string, datetime timestamp_ntz, close double")
    assert hidden.regimes(df).count() == 0
    assert hidden.Settings(states=5).labels[4] == "state_4" and hidden.Settings(states=4).labels[3] == "crisis"
