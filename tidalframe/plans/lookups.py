"""Lookup, calendar, session and larger-timeframe queries."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from ..functions import clock, lookups
from ..operators import normalise, resample
from ..sources.bars import LI_BARS_SQL, ev_bars, ev_bars_sql, li_bars
from .cleaning import _IN
from .features import full, mean
from .registry import query, rounded

W = "PARTITION BY symbol ORDER BY datetime"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows) + ")"


def even(x: float, digits: int) -> float:
    """x rounded half to even by the digits that it is written with."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


_NAMES = {"A": "MES", "N": "MGC"}
_HORIZONS = (1, 5, 10, 15, 20, 30)


def keyed(bars):
    """Bars under the names of instruments, each with a horizon by its day."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), F.col("symbol")), F.lit("XYZ"))
    horizon = F.get(F.array(*map(F.lit, _HORIZONS)), F.day("datetime") % len(_HORIZONS))
    return bars.withColumns({"symbol": name, "horizon": horizon})


_NAMED = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE 'XYZ' END"
BARRIERS_SQL = f"""WITH {LI_BARS_SQL}, k AS (SELECT {_NAMED} AS symbol, datetime, {list(_HORIZONS)}[day(datetime) % {len(_HORIZONS)} + 1]::INTEGER AS horizon FROM b),
o AS (SELECT * FROM {_values(lookups.BARRIERS)} t(symbol, horizon, u, d, b)), z AS (SELECT * FROM {_values(lookups.BARRIERS_DEFAULT)} t(horizon, u, d, b)),
r AS (SELECT k.symbol, k.datetime, k.horizon, coalesce(o.u, z.u, 1 + 1.5 * k.horizon / 20)::DOUBLE AS k_up, coalesce(o.d, z.d, 1 + 1.5 * k.horizon / 20)::DOUBLE AS k_down, coalesce(o.b, z.b, greatest(5, 3 * k.horizon))::INTEGER AS max_bars
  FROM k LEFT JOIN o ON o.symbol = k.symbol AND o.horizon = k.horizon LEFT JOIN z ON z.horizon = k.horizon)"""


@query("barrier_lookup", f"{BARRIERS_SQL} SELECT symbol, datetime, horizon, round(k_up, 6) AS k_up, round(k_down, 6) AS k_down, max_bars FROM r")
def barrier_lookup(spark, d):
    return rounded(lookups.barriers(keyed(li_bars(spark, d)).select("symbol", "datetime", "horizon")))


_COSTS = "(VALUES ('MES', 'low_vol', 1.5::DOUBLE, 1.25::DOUBLE), ('MES', 'high_vol', 2.5, 1.25), ('MGC', 'low_vol', 1.8, 1.0), ('MGC', 'high_vol', 3.3, 1.0), ('XYZ', 'low_vol', 1.5, 1.0), ('XYZ', 'high_vol', 2.5, 1.0)) t(symbol, regime, ticks, tick_value)"


@query("trade_costs", f"""WITH {LI_BARS_SQL}, k AS (SELECT {_NAMED} AS symbol, datetime, CASE WHEN (high - low) / close > 0.5 THEN 'high_vol' ELSE 'low_vol' END AS regime FROM b)
SELECT symbol, datetime, regime, ticks, tick_value, round(ticks * tick_value, 6) AS cost FROM k JOIN {_COSTS} USING (symbol, regime)""")  # fmt: skip
def trade_costs(spark, d):
    wide = (F.col("high") - F.col("low")) / F.col("close") > 0.5
    k = keyed(li_bars(spark, d)).withColumn("regime", F.when(wide, "high_vol").otherwise("low_vol"))
    ticks, value = F.round(lookups.trade_cost(F.col("symbol"), F.col("regime")), 6), lookups.tick_value(F.col("symbol"))
    return k.select("symbol", "datetime", "regime", ticks.alias("ticks"), value.alias("tick_value"), F.round(ticks * value, 6).alias("cost"))


_HOL = "h(day, kind) AS (VALUES (DATE '2024-01-01', 'holiday'), (DATE '2024-01-15', 'holiday'))"


@query("day_types", f"WITH {ev_bars_sql(60)}, {_HOL} SELECT symbol, datetime, CASE WHEN isodow(datetime) > 5 THEN 'weekend' ELSE coalesce(kind, 'regular') END AS day_type FROM b LEFT JOIN h ON datetime::DATE = day")
def day_types(spark, d):
    return clock.with_day_type(ev_bars(spark, d, 60), lookups.market_days(spark, range(2024, 2027))).select("symbol", "datetime", "day_type")


@query("trading_days", f"WITH {ev_bars_sql(60)}, {_HOL}, g AS (SELECT unnest(generate_series(min(datetime)::DATE, max(datetime)::DATE, INTERVAL 1 DAY))::DATE AS day FROM b) SELECT day FROM g WHERE isodow(day) <= 5 AND day NOT IN (SELECT day FROM h)")
def trading_days(spark, d):
    return clock.trading_days(ev_bars(spark, d, 60), lookups.market_days(spark, range(2024, 2027)))


_FIT = f"""WITH {ev_bars_sql(30)}, m AS ({' UNION ALL '.join(f"SELECT '{s}' AS session, close AS x FROM b WHERE {e}" for s, e in _IN.items())}),
f AS (SELECT session, avg(x) AS mean, CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END AS std, quantile_cont(x, 0.5) AS median, CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END AS iqr FROM m GROUP BY session)"""


@query("session_fit", f"{_FIT} SELECT session, 'close' AS name, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(iqr, 6) AS iqr FROM f")
def session_fit(spark, d):
    return rounded(normalise.session_fit(ev_bars(spark, d, 30), ["close"]))


@query("session_normalise", f"{_FIT}, s AS (SELECT *, CASE WHEN {_IN['asia']} THEN 'asia' WHEN {_IN['london']} THEN 'london' WHEN {_IN['new_york']} THEN 'new_york' END AS session FROM b) SELECT symbol, datetime, round((close - mean) / std, 6) AS close_session_norm FROM s LEFT JOIN f USING (session)")
def session_normalise(spark, d):
    b = ev_bars(spark, d, 30)
    return rounded(normalise.session_apply(b, normalise.session_fit(b, ["close"]), ["close"]).select("symbol", "datetime", "close_session_norm"))


@query("session_ratios", f"{_FIT} SELECT session, round(mean / (SELECT avg(close) FROM b), 6) AS ratio FROM f")
def session_ratios(spark, d):
    return rounded(normalise.session_ratios(ev_bars(spark, d, 30), "close"))


_RS4 = "h AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, datetime, TIMESTAMP '1970-01-01') AS datetime, first(open ORDER BY b.datetime) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY b.datetime) AS close FROM b GROUP BY ALL)"


@query("mtf_indicators", f"""WITH {ev_bars_sql(60)}, {_RS4}, f AS (SELECT *, lag(close) OVER ({W}) AS c0 FROM h), g AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(close - c0, 0) END AS up, CASE WHEN c0 IS NOT NULL THEN greatest(c0 - close, 0) END AS dn, greatest(high - low, coalesce(abs(high - c0), 0), coalesce(abs(low - c0), 0)) AS tr FROM f),
s AS (SELECT *, {mean('close', 20)} AS m, {full(20, 'close', 'stddev_samp(close) @')} AS sd, {mean('close', 50)} AS m50, {mean('up', 14)} AS u, {mean('dn', 14)} AS d, {mean('tr', 14)} AS a FROM g)
SELECT symbol, datetime, round(m, 6) AS sma_20_4h, round(m50, 6) AS sma_50_4h, round(CASE WHEN d = 0 THEN 0 ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi_14_4h, round(a, 6) AS atr_14_4h, round((close - (m - 2 * sd)) / nullif(4 * sd, 0), 6) AS bb_position_4h, round(close / nullif(m, 0) - 1, 6) AS price_to_sma_20_4h FROM s""")  # fmt: skip
def mtf_indicators(spark, d):
    ind = normalise.mtf_indicators(resample.resample(ev_bars(spark, d, 60), 240), "4h")
    return rounded(ind.select("symbol", "datetime", "sma_20_4h", "sma_50_4h", "rsi_14_4h", "atr_14_4h", "bb_position_4h", "price_to_sma_20_4h"))


@query("mtf_features")
def mtf_features(spark, d):
    return rounded(normalise.with_timeframes(ev_bars(spark, d, 60), [240, 1440], 60))


