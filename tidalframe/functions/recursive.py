"""Recursive indicators: filters and state machines that need the value of the bar before.

They run as NumPy scans over Arrow batches, one (symbol, block) at a time.  A filter's memory of
its start fades as (1 - alpha)^n, so a block that starts WARM * period rows early gives
the whole series' values to double precision; the first block has the true seeds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import BLOCK, BLOCK_ROWS, INDEX, KEY, TIME, blocked, indexed
from ..tables import kept

WARM = 40


def ema(x: np.ndarray, period: int) -> np.ndarray:
    """Seeded with the mean of the first `period` valid values; a missing value carries the last one on."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) < period:
        return out
    first = ok[0]
    if first + period > len(x):
        return out
    a = 2.0 / (period + 1)
    i = first + period - 1
    y = out[i] = np.nanmean(x[first : first + period])
    for j in range(i + 1, len(x)):
        if x[j] == x[j]:
            y = a * x[j] + (1 - a) * y
        out[j] = y
    return out


def ewm(x: np.ndarray, span: int) -> np.ndarray:
    """Seeded with the first value; missing before `span` rows."""
    out = np.full(len(x), np.nan)
    a, y = 2.0 / (span + 1), np.nan
    for i, v in enumerate(x):
        y = v if y != y else a * v + (1 - a) * y
        if i >= span - 1:
            out[i] = y
    return out


def wilder(x: np.ndarray, period: int, start: int = 1) -> np.ndarray:
    """Mean of x[start : start + period] at the last of these, then (y (p - 1) + x) / p."""
    out = np.full(len(x), np.nan)
    i = start + period - 1
    if i >= len(x):
        return out
    y = out[i] = x[start : start + period].mean()
    for j in range(i + 1, len(x)):
        y = out[j] = (y * (period - 1) + x[j]) / period
    return out


def rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    d = np.diff(close, prepend=close[:1])
    gain, loss = wilder(np.maximum(d, 0), period), wilder(np.maximum(-d, 0), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)) + 0 * gain


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first bar has none: 0."""
    before = np.concatenate([c[:1], c[:-1]])
    tr = np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))
    tr[:1] = 0
    return tr


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, period: int = 14) -> np.ndarray:
    return wilder(true_range(h, low, c), period)


def adx(h: np.ndarray, low: np.ndarray, c: np.ndarray, period: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ADX, +DI, -DI) of Wilder's running sums."""
    n = len(c)
    up, down = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    sums = [wilder(x, period) * period for x in (true_range(h, low, c), plus, minus)]  # S - S / p + x is p times that mean
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi, mdi = (np.where(sums[0] > 0, 100 * s / sums[0], np.where(np.isnan(sums[0]), np.nan, 0.0)) for s in sums[1:])
        dx = np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.where(np.isnan(pdi), np.nan, 0.0))
    out = np.full(n, np.nan)
    if n >= 2 * period:
        out = wilder(np.nan_to_num(dx), period, period)
    return out, pdi, mdi


def supertrend(h: np.ndarray, low: np.ndarray, c: np.ndarray, period: int = 10, mult: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): bands carry over while prices stay inside; the direction starts at 1 with the first ATR."""
    a = atr(h, low, c, period)
    n = len(c)
    line, side = np.full(n, np.nan), np.full(n, np.nan)
    if n <= period:
        return line, side
    mid = (h + low) / 2
    up, down = mid + mult * a, mid - mult * a
    d = 1.0
    line[period], side[period] = down[period], d
    for i in range(period + 1, n):
        if not (down[i] > down[i - 1] or c[i - 1] < down[i - 1]):
            down[i] = down[i - 1]
        if not (up[i] < up[i - 1] or c[i - 1] > up[i - 1]):
            up[i] = up[i - 1]
        d = (-1.0 if c[i] < down[i] else 1.0) if d == 1.0 else (1.0 if c[i] > up[i] else -1.0)
        line[i], side[i] = (down[i] if d == 1.0 else up[i]), d
    return line, side


def scanned(df: DataFrame, columns: list[str], make: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: list[str], warm: int | None, keep: list[str]) -> DataFrame:
    """keep and double columns `names` that make gives for the ordered rows of each block.

    warm: rows before a block that it starts from; None for state that does not
    fade, whose symbols are scanned whole (`columns` alone go through Python).
    """
    placed = indexed(df)
    placed = blocked(placed, warm) if warm is not None else placed.withColumns({BLOCK: F.lit(0).cast("long"), "_core": F.lit(True)})
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), *(f"{n} double" for n in names)])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(INDEX)
        got = make(p)
        return p[keep].assign(**{n: got[n] for n in names})[p["_core"].to_numpy()]

    cols = list(dict.fromkeys([*keep, *columns, KEY, INDEX, BLOCK, "_core"]))
    out = placed.select(*cols).groupBy(KEY, BLOCK).applyInPandas(run, schema)
    return out.select(*keep, *[F.when(F.isnan(n), None).otherwise(F.col(n)).alias(n) for n in names])


def indicators(df: DataFrame, emas=(9, 12, 21, 26, 50), atrs=(7, 14, 21), keep: list[str] | None = None) -> DataFrame:
    """All fading indicators in one scan, each as of the bar before."""
    keep = keep or [KEY, TIME]
    names = [*(f"ema_{n}" for n in emas), *(f"price_to_ema_{n}" for n in emas), "rsi_14", "macd_line", "macd_signal", "macd_hist", *(f"atr_{n}" for n in atrs), *(f"atr_pct_{n}" for n in atrs), "kc_middle", "kc_upper", "kc_lower", "kc_position", "close_kc_atr_dev", "adx_14", "plus_di_14", "minus_di_14"]

    def make(p: pd.DataFrame) -> dict[str, np.ndarray]:
        h, low, c = (p[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
        out: dict[str, np.ndarray] = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in emas:
                e = ema(c, n)
                out |= {f"ema_{n}": e, f"price_to_ema_{n}": c / e - 1}
            line = ema(c, 12) - ema(c, 26)
            signal = ema(line, 9)
            out |= {"rsi_14": rsi(c), "macd_line": line, "macd_signal": signal, "macd_hist": line - signal}
            for n in atrs:
                a = atr(h, low, c, n)
                out |= {f"atr_{n}": a, f"atr_pct_{n}": 100 * a / c}
            m, a = ema(c, 20), atr(h, low, c, 20)
            up, down = m + 2 * a, m - 2 * a
            out |= {"kc_middle": m, "kc_upper": up, "kc_lower": down, "kc_position": np.where(up > down, (c - down) / (up - down), np.nan), "close_kc_atr_dev": np.where(a > 0, (c - m) / a, np.nan)}
            out["adx_14"], out["plus_di_14"], out["minus_di_14"] = adx(h, low, c)
        return {k: np.concatenate([[np.nan], x[:-1]]) for k, x in out.items()}

    got = scanned(df, ["high", "low", "close"], make, names, WARM * max(*emas, *atrs, 28), keep)
    flag = lambda cond: F.coalesce(cond.cast("int"), F.lit(0))
    c = F.col
    return got.withColumns({"rsi_overbought": flag(c("rsi_14") > 70), "rsi_oversold": flag(c("rsi_14") < 30), "adx_strong_trend": flag(c("adx_14") > 25)})


def carried(raw: np.ndarray, before: np.ndarray, enter: float) -> np.ndarray:
    """A band that holds until raw rises over it or the close before falls under it; then it is raw."""
    out, d = np.empty(len(raw)), enter
    for i, (r, c) in enumerate(zip(raw.tolist(), before.tolist(), strict=True)):
        if r > d or c < d:
            d = r
        out[i] = d
    return out


def band_map(raw: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a block does to the band that enters it: (starts of pieces, ascending from -inf; the band that leaves, NaN for the one that entered).

    A band that enters falls at the first row with raw over it or the close before under it, so its row depends on the
    running extremes alone.  Bands that have fallen are followed together: a queue has their values in order, each
    row takes those out of both ends that it resets, and these go on as one.
    """
    n = len(raw)
    value, parent = raw.copy(), np.arange(n + 1)
    queue: deque[int] = deque()
    high, low = -np.inf, np.inf
    rises, falls = [], []  # rows where the running extremes change
    for t, (r, c) in enumerate(zip(raw.tolist(), before.tolist(), strict=True)):
        new = False
        if r > high:
            high, new = r, True
            rises.append(t)
        if c < low:
            low, new = c, True
            falls.append(t)
        while queue and value[queue[0]] < r:
            parent[queue.popleft()], new = t, True
        while queue and value[queue[-1]] > c:
            parent[queue.pop()], new = t, True
        if new and r == r:
            queue.appendleft(t)
    for t in range(n - 1, -1, -1):  # parents are later rows
        parent[t] = parent[parent[t]]
    up, down = raw[rises], before[falls]
    edges = np.unique(np.concatenate([up, down]))
    points = np.unique(np.concatenate([[-np.inf], edges, np.nextafter(edges, np.inf)]))
    rows_up, rows_down = np.append(rises, n).astype(int), np.append(falls, n).astype(int)
    first = np.minimum(rows_up[np.searchsorted(up, points, side="right")], rows_down[np.searchsorted(-down, -points, side="right")])
    leaves = np.where(first < n, np.append(value, np.nan)[parent[np.minimum(first, n)]], np.nan)
    turns = np.concatenate([[True], ~((leaves[1:] == leaves[:-1]) | (np.isnan(leaves[1:]) & np.isnan(leaves[:-1])))])
    return points[turns], leaves[turns]


def sides(c: np.ndarray, down: np.ndarray, up: np.ndarray, enter: float) -> np.ndarray:
    out, d = np.empty(len(c)), enter
    for i, (below, above) in enumerate(zip((c < down).tolist(), (c > up).tolist(), strict=True)):
        d = (-1.0 if below else 1.0) if d == 1.0 else (1.0 if above else -1.0)
        out[i] = d
    return out


def supertrends(df: DataFrame, period: int = 10, mult: float = 3.0, keep: list[str] | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """supertrend and supertrend_direction of the bar before.

    State that does not fade is handed from block to block: a first pass makes each block's map of the bands that may enter it, a narrow pass over
    a symbol's maps gives the bands that do, a second pass follows both directions that may enter, and one more narrow pass picks.
    """
    keep = keep or [KEY, TIME]
    kind = dict(df.dtypes)
    placed = kept(indexed(df), "indexed")
    prices = blocked(placed.select(KEY, INDEX, "high", "low", "close"), WARM * period, rows=rows)

    def ranges(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(INDEX)
        h, low, c = (p[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
        a, mid = atr(h, low, c, period), (h + low) / 2
        out = pd.DataFrame({KEY: p[KEY], INDEX: p[INDEX], BLOCK: p[BLOCK], "c": c, "before": np.concatenate([[np.nan], c[:-1]]), "down": mid - mult * a, "up": mid + mult * a})
        return out[p["_core"].to_numpy()]

    raw = prices.groupBy(KEY, BLOCK).applyInPandas(ranges, f"{KEY} {kind[KEY]}, {INDEX} long, {BLOCK} long, c double, before double, down double, up double")
    raw = kept(raw, "ranges")

    def mapped(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(INDEX)
        before, down, up = (p[x].to_numpy(dtype=float) for x in ("before", "down", "up"))
        (ds, dv), (us, uv) = band_map(down, before), band_map(-up, -before)  # the upper band is the lower one of negated prices
        return pd.DataFrame({KEY: [p[KEY].iloc[0]], BLOCK: [p[BLOCK].iloc[0]], "ds": [ds.tolist()], "dv": [dv.tolist()], "us": [us.tolist()], "uv": [uv.tolist()]})

    def chained(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(BLOCK)
        out = {}
        for side in "du":
            enter, values = -np.inf, []
            for starts, leaves in zip(p[f"{side}s"], p[f"{side}v"], strict=True):
                values.append(enter)
                got = leaves[int(np.searchsorted(starts, enter, side="right")) - 1]
                enter = enter if got != got else got
            out[side] = np.array(values)
        return pd.DataFrame({KEY: p[KEY], BLOCK: p[BLOCK], "down_in": out["d"], "up_in": -out["u"]})

    maps = raw.groupBy(KEY, BLOCK).applyInPandas(mapped, f"{KEY} {kind[KEY]}, {BLOCK} long, ds array<double>, dv array<double>, us array<double>, uv array<double>")
    enter = maps.groupBy(KEY).applyInPandas(chained, f"{KEY} {kind[KEY]}, {BLOCK} long, down_in double, up_in double")

    def followed(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        """Of the row before each: the bands, and the direction for either one that may enter."""
        p = p.sort_values(INDEX)
        at, c, before = (p[x].to_numpy() for x in (INDEX, "c", "before"))
        d0, u0 = float(e["down_in"].iloc[0]), float(e["up_in"].iloc[0])
        down, up = carried(p["down"].to_numpy(), before, d0), -carried(-p["up"].to_numpy(), -before, -u0)
        seen = np.where(at > period, c, np.nan)  # the first direction is 1
        plus, minus = sides(seen, down, up, 1.0), sides(seen, down, up, -1.0)
        late = lambda first, x: np.concatenate([[first], x[:-1]])
        return pd.DataFrame({KEY: p[KEY], INDEX: at, BLOCK: p[BLOCK], "down": late(d0, down), "up": late(u0, up), "plus": late(1.0, plus), "minus": late(-1.0, minus), "plus_out": plus[-1], "minus_out": minus[-1]})

    both = raw.groupBy(KEY, BLOCK).cogroup(enter.groupBy(KEY, BLOCK)).applyInPandas(followed, f"{KEY} {kind[KEY]}, {INDEX} long, {BLOCK} long, down double, up double, plus double, minus double, plus_out double, minus_out double")
    both = kept(both, "bands")

    def turned(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(BLOCK)
        d, out = 1.0, []
        for plus, minus in zip(p["plus_out"], p["minus_out"], strict=True):
            out.append(d)
            d = plus if d == 1.0 else minus
        return pd.DataFrame({KEY: p[KEY], BLOCK: p[BLOCK], "_d": np.array(out)})

    ends = both.groupBy(KEY, BLOCK).agg(F.any_value("plus_out").alias("plus_out"), F.any_value("minus_out").alias("minus_out"))
    turns = ends.groupBy(KEY).applyInPandas(turned, f"{KEY} {kind[KEY]}, {BLOCK} long, _d double")
    side = F.when(F.col("_d") == 1.0, F.col("plus")).otherwise(F.col("minus"))
    known = both.join(turns, [KEY, BLOCK]).where(F.col(INDEX) > period).select(KEY, INDEX, F.when(side == 1.0, F.col("down")).otherwise(F.col("up")).alias("supertrend"), side.alias("supertrend_direction"))
    out = placed.join(known, [KEY, INDEX], "left")
    return out.select(*keep, F.when(~F.isnan("supertrend"), F.col("supertrend")).alias("supertrend"), "supertrend_direction")
