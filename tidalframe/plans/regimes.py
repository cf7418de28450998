"""Queries of regimes, and of session and prediction-set forms that came with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups
from ..operators import hidden, normalise, regimes, stats
from ..quantiles import quantiles
from ..sources.bars import LI_BARS_SQL, ev_bars, li_bars
from .evaluation import _P0, _Q, _X
from .features import _A
from .labelling import predictions
from .lookups import _FIT, _IN, _values, even
from .registry import query, rounded
from .scans import _ADX, _J

_W = "PARTITION BY symbol ORDER BY datetime"


def _mean(c: str, n: int) -> str:
    rows = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {rows} = {n} THEN avg({c}) {rows} END"


_H = f"OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_BASIC = f"""WITH {LI_BARS_SQL}, f AS (SELECT *, lag(close) OVER ({_W}) AS c1, lag(close, 2) OVER ({_W}) AS c2 FROM b),
g AS (SELECT *, {_mean('c1', 50)} AS a, {_mean('c1', 200)} AS z, CASE WHEN c1 / nullif(c2, 0) > 0 THEN ln(c1 / nullif(c2, 0)) END AS r FROM f),
h AS (SELECT *, CASE WHEN count(r) {_H} = 20 THEN stddev_samp(r) {_H} END * {_A} AS v FROM g),
q AS (SELECT *, quantile_cont(v, 0.5) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM h)
SELECT symbol, datetime, CAST(coalesce(v > m, false) AS INTEGER) AS volatility_flag, CAST(CASE WHEN c1 > a AND a > z THEN 1 WHEN c1 < a AND a < z THEN -1 ELSE 0 END AS INTEGER) AS trend_flag FROM q"""


@query("regimes_basic", _BASIC)
def regimes_basic(spark, d):
    return regimes.add(li_bars(spark, d)).select("symbol", "datetime", "volatility_flag", "trend_flag")


_DETECT = f"""{_ADX}, x AS (SELECT i.symbol, i.datetime, i.close, ax.y AS adx, a.a AS atr, CASE WHEN count(i.close) OVER w = 50 THEN avg(i.close) OVER w END AS m FROM i {_J.format('ax')} {_J.format('a')} WINDOW w AS (PARTITION BY i.symbol ORDER BY i.datetime ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, quantile_cont(atr, 0.25) OVER w AS q1, quantile_cont(atr, 0.75) OVER w AS q3 FROM x WINDOW w AS ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, datetime, CASE WHEN atr IS NULL THEN NULL WHEN atr <= q1 THEN 'low' WHEN atr >= q3 THEN 'high' ELSE 'normal' END AS v, CASE WHEN adx IS NULL OR m IS NULL THEN NULL WHEN adx > 25 AND close > m THEN 'uptrend' WHEN adx > 25 AND close < m THEN 'downtrend' ELSE 'sideways' END AS t FROM q),
s AS (SELECT symbol, datetime, lag(v) OVER ({_W}) AS volatility_regime, lag(t) OVER ({_W}) AS trend_regime FROM g)"""
_TWO = ("volatility", "trend")


@query("regimes_advanced", f"{_DETECT} SELECT symbol, datetime, volatility_regime, trend_regime, concat_ws('_', volatility_regime, trend_regime) AS regime FROM s")
def regimes_advanced(spark, d):
    return regimes.add(li_bars(spark, d), True, detectors=_TWO).select("symbol", "datetime", "volatility_regime", "trend_regime", "regime")


@query("regime_routing", f"{_DETECT}, m AS (SELECT CASE volatility_regime WHEN 'low' THEN 'calm' WHEN 'high' THEN 'wild' ELSE 'usual' END AS model FROM s) SELECT model, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY model")
def regime_routing(spark, d):
    x = regimes.advanced(li_bars(spark, d), ("volatility",))
    return rounded(regimes.routing_summary(regimes.routed(x, "volatility_regime", {"low": "calm", "high": "wild"}, "usual")))


_ST = ("trending", "random", "mean_reverting")
_FACTORS = {(kind, name): x for kind, name, *x in lookups.REGIMES}
_ONE = [1.0, 1.0, 1.0]


def _adjusted(v: str, t: str, r: str) -> tuple:
    f = [1.0 * a * b * c for a, b, c in zip(_FACTORS.get(("volatility", v), _ONE), _FACTORS.get(("trend", t), _ONE), _FACTORS.get(("structure", r), _ONE), strict=True)]
    return v, t, r, even(1.5 * f[0], 4), even(1.1 * f[1], 4), max(1, int(even(12 * f[2], 0)))


_ALL = [_adjusted(v, t, r) for v in ("low", "normal", "high", "") for t in ("uptrend", "downtrend", "sideways", "") for r in _ST]


@query("regime_barriers", f"""{_DETECT}, m AS (SELECT * FROM {_values(_ALL)} t(v, t, r, u, d, b)), k AS (SELECT *, {list(_ST)}[day(datetime) % 3 + 1] AS structure_regime FROM s)
SELECT symbol, datetime, volatility_regime, trend_regime, structure_regime, u::DOUBLE AS k_up, d::DOUBLE AS k_down, b::INTEGER AS max_bars
FROM k JOIN m ON v = coalesce(volatility_regime, '') AND t = coalesce(trend_regime, '') AND r = structure_regime""")  # fmt: skip
def regime_barriers(spark, d):
    x = regimes.advanced(li_bars(spark, d), _TWO).withColumn("structure_regime", F.get(F.array(*map(F.lit, _ST)), F.day("datetime") % 3))
    names = ("volatility_regime", "trend_regime", "structure_regime")
    k = x.select("symbol", "datetime", *names).withColumns({"k_up": F.lit(1.5), "k_down": F.lit(1.1), "max_bars": F.lit(12)})
    return lookups.adjusted(k, *names)


@query("session_volatility", f"{_FIT.replace('close AS x', '(high - low) AS x')}, s AS (SELECT *, CASE WHEN {_IN['asia']} THEN 'asia' WHEN {_IN['london']} THEN 'london' WHEN {_IN['new_york']} THEN 'new_york' END AS session FROM b) SELECT symbol, datetime, round(CASE WHEN session IS NULL THEN NULL WHEN mean = 0 THEN close ELSE close / mean END, 6) AS close_session_norm FROM s LEFT JOIN f USING (session)")
def session_volatility(spark, d):
    b = ev_bars(spark, d, 30).withColumn("range", F.col("high") - F.col("low"))
    return rounded(normalise.by_session(b, ["close"], "volatility", "range").select("symbol", "datetime", "close_session_norm"))


_P = "[m0_p0, m0_p1, m0_p2]"
_RANKED = f"""r AS (SELECT *, list_reverse_sort({_P}) AS sp, list_transform([0, 1, 2], lambda k: len(list_filter([0, 1, 2], lambda j: {_P}[j + 1] > {_P}[k + 1] OR ({_P}[j + 1] = {_P}[k + 1] AND j < k)))) AS rk FROM z),
t AS (SELECT *, [sp[1], sp[1] + sp[2], sp[1] + sp[2] + sp[3]] AS cum FROM r)"""


@query("conformal_aps", f"""{_X}, {_RANKED}, q AS (SELECT {_Q}(cum[rk[y + 1] + 1], 0.9) AS q FROM t WHERE row_id % 2 = 0)
SELECT row_id, array_to_string(list_filter([0, 1, 2], lambda k: rk[k + 1] = 0 OR cum[rk[k + 1] + 1] <= q + 1e-12), ',') AS classes FROM t, q WHERE row_id % 2 = 1""")  # fmt: skip
def conformal_aps(spark, d):
    x = predictions(spark, d)
    scores = x.where("row_id % 2 = 0").select(stats.conformal_score("y", _P0, "aps").alias("s"))
    q = quantiles(scores, [], "s", [0.9]).select(F.col("q")[0].alias("q"))
    return stats.conformal_sets(x.where("row_id % 2 = 1"), q, _P0, "aps").select("row_id", F.array_join("classes", ",").alias("classes"))


@query("hmm_regimes")
def hmm_regimes(spark, d):
    return hidden.regimes(li_bars(spark, d))
