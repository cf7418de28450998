"""Recursive, array and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, recursive
from ..operators import clean
from ..series import Rolling, with_features
from ..sources.bars import LI_BARS_SQL, ev_bars, ev_bars_sql, li_bars
from .features import full, mean
from .registry import query, rounded

W = "PARTITION BY symbol ORDER BY datetime"
_I = f"WITH RECURSIVE {LI_BARS_SQL}, i AS (SELECT symbol, datetime, open, high, low, close, volume, row_number() OVER ({W}) - 1 AS k, lag(close) OVER ({W}) AS c0, lag(high) OVER ({W}) AS h0, lag(low) OVER ({W}) AS l0 FROM b)"


def _ema(name: str, x: str, n: int, src: str = "i", first: int = 0) -> str:
    a = 2 / (n + 1)
    return f"{name}(symbol, k, y) AS (SELECT symbol, k, (SELECT avg({x}) FROM {src} s WHERE s.symbol = {src}.symbol AND s.k BETWEEN {first} AND {first + n - 1}) FROM {src} WHERE k = {first + n - 1} UNION ALL SELECT s.symbol, s.k, {a!r} * s.{x} + (1 - {a!r}) * r.y FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.k = r.k + 1)"


def _wilder(name: str, xs: dict[str, str], p: int, src: str) -> str:
    cols = ", ".join(xs)
    seeds = ", ".join(f"(SELECT avg(s.{x}) FROM {src} s WHERE s.symbol = {src}.symbol AND s.k BETWEEN 1 AND {p})" for x in xs.values())
    nxt = ", ".join(f"(r.{v} * {p - 1} + s.{x}) / {p}" for v, x in xs.items())
    return f"{name}(symbol, k, {cols}) AS (SELECT symbol, k, {seeds} FROM {src} WHERE k = {p} UNION ALL SELECT s.symbol, s.k, {nxt} FROM {name} r JOIN {src} s ON s.symbol = r.symbol AND s.k = r.k + 1)"


def _lagged(cols: dict[str, str], joins: str) -> str:
    return f"SELECT i.symbol, i.datetime, {', '.join(f'round(lag({e}) OVER (PARTITION BY i.symbol ORDER BY i.k), 6) AS {n}' for n, e in cols.items())} FROM i {joins}"


_J = "LEFT JOIN {0} ON {0}.symbol = i.symbol AND {0}.k = i.k"


def _ind(*names):
    def run(spark, d):
        return rounded(recursive.indicators(li_bars(spark, d)).select("symbol", "datetime", *names))

    return run


query("ema_recursive", f"{_I}, {_ema('e9', 'close', 9)}, {_ema('e21', 'close', 21)}, {_ema('e50', 'close', 50)} " + _lagged({k: e for n in (9, 21, 50) for k, e in ((f"ema_{n}", f"e{n}.y"), (f"price_to_ema_{n}", f"i.close / e{n}.y - 1"))}, " ".join(_J.format(f"e{n}") for n in (9, 21, 50))))(
    _ind(*[c for n in (9, 21, 50) for c in (f"ema_{n}", f"price_to_ema_{n}")])
)
query("macd", f"{_I}, {_ema('e12', 'close', 12)}, {_ema('e26', 'close', 26)}, m AS (SELECT e26.symbol, e26.k, e12.y - e26.y AS line FROM e26 JOIN e12 USING (symbol, k)), {_ema('sg', 'line', 9, 'm', 25)} " + _lagged({"macd_line": "m.line", "macd_signal": "sg.y", "macd_hist": "m.line - sg.y"}, " ".join(_J.format(x) for x in ("m", "sg"))))(_ind("macd_line", "macd_signal", "macd_hist"))
_G = "g AS (SELECT symbol, k, greatest(coalesce(close - c0, 0), 0) AS up, greatest(coalesce(c0 - close, 0), 0) AS dn FROM i)"
_RSI = "CASE WHEN r.d = 0 THEN 100 ELSE 100 - 100 / (1 + r.u / r.d) END"
query("rsi_wilder", f"{_I}, {_G}, {_wilder('r', {'u': 'up', 'd': 'dn'}, 14, 'g')}, x AS ({_lagged({'rsi_14': _RSI}, _J.format('r'))}) SELECT symbol, datetime, rsi_14, CAST(coalesce(rsi_14 > 70, false) AS INTEGER) AS rsi_overbought, CAST(coalesce(rsi_14 < 30, false) AS INTEGER) AS rsi_oversold FROM x")(_ind("rsi_14", "rsi_overbought", "rsi_oversold"))
_T = "t AS (SELECT symbol, k, CASE WHEN c0 IS NULL THEN 0 ELSE greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr, CASE WHEN high - h0 > l0 - low AND high - h0 > 0 THEN high - h0 ELSE 0 END AS pdm, CASE WHEN l0 - low > high - h0 AND l0 - low > 0 THEN l0 - low ELSE 0 END AS mdm FROM i)"
query("atr_wilder", f"{_I}, {_T}, " + ", ".join(_wilder(f"a{n}", {"a": "tr"}, n, "t") for n in (7, 14, 21)) + " " + _lagged({k: e for n in (7, 14, 21) for k, e in ((f"atr_{n}", f"a{n}.a"), (f"atr_pct_{n}", f"100 * a{n}.a / i.close"))}, " ".join(_J.format(f"a{n}") for n in (7, 14, 21))))(_ind(*[c for n in (7, 14, 21) for c in (f"atr_{n}", f"atr_pct_{n}")]))
query("keltner", f"{_I}, {_T}, {_wilder('a', {'a': 'tr'}, 20, 't')}, {_ema('e', 'close', 20)} " + _lagged({"kc_middle": "CASE WHEN a.a IS NOT NULL OR e.y IS NOT NULL THEN e.y END", "kc_upper": "e.y + 2 * a.a", "kc_lower": "e.y - 2 * a.a", "kc_position": "(i.close - (e.y - 2 * a.a)) / nullif(4 * a.a, 0)", "close_kc_atr_dev": "(i.close - e.y) / nullif(a.a, 0)"}, " ".join(_J.format(x) for x in ("a", "e"))))(_ind("kc_middle", "kc_upper", "kc_lower", "kc_position", "close_kc_atr_dev"))
_ADX = f"{_I}, {_T}, {_wilder('a', {'a': 'tr', 'p': 'pdm', 'm': 'mdm'}, 14, 't')}, di AS (SELECT symbol, k, 100 * p / nullif(a, 0) AS pdi, 100 * m / nullif(a, 0) AS mdi FROM a), dx AS (SELECT symbol, k, pdi, mdi, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM di), ax(symbol, k, y) AS (SELECT symbol, k, (SELECT avg(s.dx) FROM dx s WHERE s.symbol = dx.symbol AND s.k BETWEEN 14 AND 27) FROM dx WHERE k = 27 UNION ALL SELECT s.symbol, s.k, (r.y * 13 + s.dx) / 14 FROM ax r JOIN dx s ON s.symbol = r.symbol AND s.k = r.k + 1)"
query("adx_di", f"{_ADX}, x AS ({_lagged({'adx_14': 'ax.y', 'plus_di_14': 'di.pdi', 'minus_di_14': 'di.mdi'}, _J.format('di') + ' ' + _J.format('ax'))}) SELECT *, CAST(coalesce(adx_14 > 25, false) AS INTEGER) AS adx_strong_trend FROM x")(_ind("adx_14", "plus_di_14", "minus_di_14", "adx_strong_trend"))


@query("atr_spikes", f"{_I}, {_T}, {_wilder('a', {'a': 'tr'}, 14, 't')} SELECT i.symbol, i.datetime, coalesce(abs(close / nullif(c0, 0) - 1) > coalesce(a.a, 0) * 5 / nullif(close, 0), false) AS outlier FROM i {_J.format('a')}")
def atr_spikes(spark, d):
    return clean.atr_spikes(li_bars(spark, d)).select("symbol", "datetime", "outlier")


@query("supertrend", f"""{_I}, {_T}, {_wilder('a', {'a': 'tr'}, 10, 't')}, z AS (SELECT i.symbol, i.k, i.close, i.c0, (i.high + i.low) / 2 + 3 * a.a AS bu, (i.high + i.low) / 2 - 3 * a.a AS bd FROM i JOIN a ON a.symbol = i.symbol AND a.k = i.k),
s(symbol, k, u, d, dir) AS (SELECT symbol, k, bu, bd, 1 FROM z WHERE k = 10 UNION ALL SELECT symbol, k, u, d, CASE WHEN dir = 1 THEN CASE WHEN close < d THEN -1 ELSE 1 END ELSE CASE WHEN close > u THEN 1 ELSE -1 END END
  FROM (SELECT z.symbol, z.k, z.close, s.dir, CASE WHEN z.bu < s.u OR z.c0 > s.u THEN z.bu ELSE s.u END AS u, CASE WHEN z.bd > s.d OR z.c0 < s.d THEN z.bd ELSE s.d END AS d FROM s JOIN z ON z.symbol = s.symbol AND z.k = s.k + 1))
{_lagged({"supertrend": "CASE WHEN s.dir = 1 THEN s.d ELSE s.u END", "supertrend_direction": "s.dir::DOUBLE"}, _J.format("s"))}""")  # fmt: skip
def supertrend(spark, d):
    return rounded(recursive.supertrends(li_bars(spark, d)))


@query("obv", f"WITH {LI_BARS_SQL}, f AS (SELECT *, lag(close) OVER ({W}) AS c0 FROM b), g AS (SELECT *, sum(coalesce(sign(close - c0) * volume, 0)) OVER ({W}) AS o FROM f) SELECT symbol, datetime, round(lag(o) OVER ({W}), 6) AS obv FROM g")
def obv(spark, d):
    return rounded(arrays.obv(li_bars(spark, d), ["symbol", "datetime"]))


@query("vwap", f"""WITH {ev_bars_sql(60)}, f AS (SELECT *, (high + low + close) / 3 AS tp FROM b), g AS (SELECT *, coalesce(sum(tp * volume) OVER x / nullif(sum(volume) OVER x, 0), tp) AS v FROM f WINDOW x AS (PARTITION BY symbol, datetime::DATE ORDER BY datetime))
SELECT symbol, datetime, round(lag(v) OVER ({W}), 6) AS vwap, round(lag(close) OVER ({W}) / nullif(lag(v) OVER ({W}), 0) - 1, 6) AS price_to_vwap FROM g""")  # fmt: skip
def vwap(spark, d):
    return rounded(arrays.vwap(ev_bars(spark, d, 60), ["symbol", "datetime"]))


_VR = f"WITH {LI_BARS_SQL}, f AS (SELECT *, {full(14, 'high', 'avg(high - low) @')} AS x FROM b), q AS (SELECT *, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.5) OVER w AS q2, quantile_cont(x, 0.75) OVER w AS q3 FROM f WINDOW w AS ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"


def _regimes(spark, d):
    r = Rolling.of_blocks()
    b = with_features(li_bars(spark, d), {"x": r.mean(F.col("high") - F.col("low"), 14)}, 14)
    x = F.col("x")
    return with_features(b, {"regime": arrays.quantile_regime(r, x), "above_median": arrays.volatility_flag(r, x)}, 100)


@query("vol_regime_quantile", f"{_VR} SELECT symbol, datetime, CASE WHEN x IS NULL THEN NULL WHEN x <= q1 THEN 'low' WHEN x >= q3 THEN 'high' ELSE 'normal' END AS regime, CAST(coalesce(x > q2, false) AS INTEGER) AS above_median FROM q")
def vol_regime_quantile(spark, d):
    return _regimes(spark, d).select("symbol", "datetime", "regime", "above_median")


@query("regime_summary", f"""{_VR}, g AS (SELECT symbol, datetime, CASE WHEN x IS NULL THEN NULL WHEN x <= q1 THEN 'low' WHEN x >= q3 THEN 'high' ELSE 'normal' END AS regime FROM q), h AS (SELECT *, CASE WHEN lag(regime) OVER ({W}) IS DISTINCT FROM regime THEN 1 ELSE 0 END AS nw FROM g)
SELECT symbol, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share, sum(nw)::BIGINT AS runs, round(count(*) / nullif(sum(nw), 0), 6) AS mean_run FROM h GROUP BY symbol, regime""")  # fmt: skip
def regime_summary(spark, d):
    r = arrays.regime_summary(_regimes(spark, d).select("symbol", "datetime", "regime"), "regime")
    return rounded(r.withColumn("runs", F.col("runs").cast("long")).withColumn("mean_run", F.col("n") / F.nullif("runs", F.lit(0))))


@query("trend_regime", f"WITH {LI_BARS_SQL}, f AS (SELECT *, lag(close) OVER ({W}) AS c1 FROM b), s AS (SELECT *, {mean('c1', 50)} AS a, {mean('c1', 200)} AS z FROM f) SELECT symbol, datetime, CAST(CASE WHEN c1 > a AND a > z THEN 1 WHEN c1 < a AND a < z THEN -1 ELSE 0 END AS INTEGER) AS trend FROM s")
def trend_regime(spark, d):
    r = Rolling.of_blocks()
    return with_features(li_bars(spark, d), {"trend": arrays.trend_flag(r)}, 202, keep=["symbol", "datetime"])


@query("regime_codes", f"{_VR}, g AS (SELECT symbol, datetime, CASE WHEN x IS NULL THEN NULL WHEN x <= q1 THEN 'low' WHEN x >= q3 THEN 'high' ELSE 'normal' END AS regime FROM q) SELECT symbol, datetime, regime, CAST(CASE regime WHEN 'high' THEN 0 WHEN 'low' THEN 1 WHEN 'normal' THEN 2 END AS INTEGER) AS regime_code FROM g")
def regime_codes(spark, d):
    return arrays.encoded(_regimes(spark, d).select("symbol", "datetime", "regime"), "regime").select("symbol", "datetime", "regime", "regime_code")


@query("wavelets")
def wavelets(spark, d):
    return rounded(arrays.wavelets(li_bars(spark, d), keep=["symbol", "datetime"]))


@query("wavelets_normalised")
def wavelets_normalised(spark, d):
    w = arrays.wavelets(li_bars(spark, d), keep=["symbol", "datetime"])
    return rounded(arrays.normalised(w, ["wavelet_close_approx", "wavelet_close_d1"]).select("symbol", "datetime", "wavelet_close_approx", "wavelet_close_d1"))


@query("hurst_structure")
def hurst_structure(spark, d):
    return rounded(arrays.hurst(li_bars(spark, d), keep=["symbol", "datetime"]))
