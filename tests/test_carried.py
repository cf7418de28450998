"""State that does not fade, handed from block to block: equal to one scan of the whole series."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidalframe.functions import recursive
from tidalframe.operators import resample


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=30), st.booleans())
def test_band_map_is_the_scan(rows, warm):
    raw, before = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    if warm:
        raw[:2] = np.nan
        before[0] = np.nan
    starts, leaves = recursive.band_map(raw, before)
    for enter in [-np.inf, *np.arange(-1, 14, 0.5), np.inf]:
        got = leaves[np.searchsorted(starts, enter, side="right") - 1]
        want = recursive.carried(raw, before, enter)[-1]
        assert (enter if np.isnan(got) else got) == want or (np.isnan(want) and np.isnan(got))


def walk(symbol, seed, n, drift=0.0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(drift + 0.01 * rng.normal(size=n)))
    h, low = c * (1 + 0.01 * rng.random(n)), c * (1 - 0.01 * rng.random(n))
    t = pd.date_range("2024-01-01", periods=n, freq="min")
    return pd.DataFrame({"symbol": symbol, "datetime": t, "open": c, "high": h, "low": low, "close": c, "volume": rng.integers(1, 100, n).astype(float)})


def test_supertrend_in_blocks_equals_one_scan(spark):
    whole = [walk("up", 1, 2600, 0.002), walk("flat", 2, 1900), walk("down", 3, 1300, -0.002), walk("short", 4, 9)]
    df = spark.createDataFrame(pd.concat(whole))
    got = recursive.supertrends(df, rows=400).orderBy("symbol", "datetime").toPandas()
    for w in whole:
        g = got[got.symbol == w.symbol.iloc[0]]
        line, side = recursive.supertrend(w.high.to_numpy(), w.low.to_numpy(), w.close.to_numpy())
        assert len(g) == len(w)
        np.testing.assert_allclose(g.supertrend.to_numpy(dtype=float), np.concatenate([[np.nan], line[:-1]]), rtol=1e-9)
        np.testing.assert_array_equal(g.supertrend_direction.to_numpy(dtype=float), np.concatenate([[np.nan], side[:-1]]))


def plain_bar_ids(size, threshold, least):
    out, bar, n, total = [], 0, 0, 0.0
    for s in size:
        out.append(bar)
        total, n = total + s, n + 1
        if total >= threshold and n >= least:
            bar, n, total = bar + 1, 0, 0.0
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 30), st.integers(1, 5), st.integers(1, 17))
def test_bar_maps_chain_to_the_scan(size, threshold, least, block):
    size = np.array(size, dtype=float)
    held, rows, bar, got = 0.0, 0, 0, []
    for lo in range(0, len(size), block):
        part = size[lo : lo + block]
        got += resample.bar_ids(part, threshold, least, held, rows, bar).tolist()
        upto, closed, h, r = resample.bar_map(part, threshold, least)
        k = max(int(np.searchsorted(upto, threshold - held, side="left")), least - rows - 1, 0)
        if k < len(upto):
            held, rows, bar = h[k], r[k], bar + closed[k]
        else:
            held, rows = held + part.sum(), rows + len(part)
    assert got == plain_bar_ids(size, threshold, least)


def test_bars_of_one_symbol_in_many_blocks(spark):
    w = pd.concat([walk("a", 1, 1500), walk("b", 2, 70), walk("c", 3, 1)])
    df = spark.createDataFrame(w)
    for build, size, least in ((resample.volume_bars, lambda x: x.volume, 3), (resample.dollar_bars, lambda x: x.close * x.volume, 1)):
        for threshold in (400.0, 90_000.0):
            got = build(df, threshold, least, block=64).toPandas()
            for symbol, x in w.groupby("symbol"):
                want = x.assign(bar_id=plain_bar_ids(size(x), threshold, least)).groupby("bar_id").agg(open=("open", "first"), close=("close", "last"), high=("high", "max"), n_bars=("open", "size"))
                g = got[got.symbol == symbol].set_index("bar_id").sort_index()[["open", "close", "high", "n_bars"]]
                pd.testing.assert_frame_equal(g, want, check_dtype=False)
