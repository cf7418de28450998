"""Cleaning, bar, clock and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import clean, resample
from ..series import Rolling, with_features
from ..sources.bars import LI_BARS_SQL, ev_bars, ev_bars_sql, ev_ticks, li_bars
from .registry import query, rounded, whole

W = "PARTITION BY symbol ORDER BY datetime"
_OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"


@query("ohlcv_daily", f"WITH {LI_BARS_SQL} SELECT symbol, datetime, open, high, low, close, volume FROM b")
def ohlcv_daily(spark, d):
    return li_bars(spark, d).select("symbol", "datetime", "open", "high", "low", "close", "volume")


@query("ohlcv_hourly", f"WITH {ev_bars_sql(60)} SELECT symbol, datetime, {_OHLC}, round(volume, 6) AS volume FROM b")
def ohlcv_hourly(spark, d):
    return rounded(ev_bars(spark, d, 60))


_RS = "first(open ORDER BY datetime) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY datetime) AS close, sum(volume) AS volume"


@query("resample_25min_anchor", f"""WITH {ev_bars_sql(1)}, a AS (SELECT symbol, date_trunc('day', min(datetime)) AS d0 FROM b GROUP BY symbol),
r AS (SELECT symbol, time_bucket(INTERVAL 25 MINUTE, datetime, d0) AS datetime, {_RS.replace('datetime)', 'b.datetime)')} FROM b JOIN a USING (symbol) GROUP BY ALL)
SELECT symbol, datetime, {_OHLC}, round(volume, 6) AS volume FROM r""")  # fmt: skip
def resample_25min(spark, d):
    return rounded(resample.resample(ev_bars(spark, d, 1), 25))


@query("resample_4h", f"""WITH {ev_bars_sql(60)}, r AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, datetime, TIMESTAMP '1970-01-01') AS datetime, {_RS.replace('datetime)', 'b.datetime)')} FROM b GROUP BY ALL)
SELECT symbol, datetime, {_OHLC}, round(volume, 6) AS volume FROM r""")  # fmt: skip
def resample_4h(spark, d):
    return rounded(resample.resample(ev_bars(spark, d, 60), 240))


def _bar_sql(size: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {ev_bars_sql(60)}, n AS (SELECT *, row_number() OVER ({W}) AS i, {size} AS z FROM b),
s(symbol, i, bar, acc) AS (SELECT symbol, i, CASE WHEN z >= {threshold} THEN 1 ELSE 0 END, CASE WHEN z >= {threshold} THEN 0 ELSE z END FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, CASE WHEN s.acc + n.z >= {threshold} THEN s.bar + 1 ELSE s.bar END, CASE WHEN s.acc + n.z >= {threshold} THEN 0 ELSE s.acc + n.z END FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1),
k AS (SELECT n.*, CASE WHEN acc = 0 THEN bar - 1 ELSE bar END AS bar_id FROM n JOIN s USING (symbol, i))
SELECT symbol, bar_id::BIGINT AS bar_id, min(datetime) AS datetime, round(first(open ORDER BY datetime), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY datetime), 6) AS close,
  round(sum(volume), 6) AS volume, count(*) AS n_bars FROM k GROUP BY symbol, bar_id"""


@query("volume_bars", _bar_sql("volume", 12.0).replace("min(datetime)", "min(k.datetime)").replace("ORDER BY datetime), 6", "ORDER BY k.datetime), 6"))
def volume_bars(spark, d):
    return rounded(resample.volume_bars(ev_bars(spark, d, 60), 12.0))


@query("dollar_bars", _bar_sql("close * volume", 900.0).replace("min(datetime)", "min(k.datetime)").replace("ORDER BY datetime), 6", "ORDER BY k.datetime), 6"))
def dollar_bars(spark, d):
    return rounded(resample.dollar_bars(ev_bars(spark, d, 60), 900.0).drop("dollar_value"))


@query("bar_estimates", f"WITH {ev_bars_sql(60)} SELECT symbol, floor(sum(volume) / 12.0)::BIGINT AS bars FROM b GROUP BY symbol")
def bar_estimates(spark, d):
    return resample.estimate_count(ev_bars(spark, d, 60), 12.0)


_META = _bar_sql("volume", 12.0).replace("min(datetime)", "min(k.datetime)").replace("ORDER BY datetime), 6", "ORDER BY k.datetime), 6")


@query("volume_bar_metadata", f"SELECT symbol, count(*) AS bars_out, sum(n_bars)::BIGINT AS bars_in, sum(n_bars) / count(*) AS compression, min(n_bars) AS min_bars, max(n_bars) AS max_bars FROM ({_META}) GROUP BY symbol")
def volume_bar_metadata(spark, d):
    return resample.bar_metadata(resample.volume_bars(ev_bars(spark, d, 60), 12.0))


def _dirty(spark, d):
    """Daily bars with defects planted by rule: swapped highs and lows, negative volumes, prices of 0."""
    b = li_bars(spark, d).withColumn("k", F.day("datetime"))
    return b.select("symbol", "datetime", F.when(F.col("k") == 3, 0.0).otherwise(F.col("open")).alias("open"), F.when(F.col("k") == 5, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(F.col("k") == 5, F.col("high")).otherwise(F.col("low")).alias("low"), "close", F.when(F.col("k") == 7, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))


_DIRTY = f"""WITH {LI_BARS_SQL}, x AS (SELECT symbol, datetime, CASE WHEN day(datetime) = 3 THEN 0.0 ELSE open END AS open, CASE WHEN day(datetime) = 5 THEN low ELSE high END AS high,
  CASE WHEN day(datetime) = 5 THEN high ELSE low END AS low, close, CASE WHEN day(datetime) = 7 THEN -volume ELSE volume END AS volume FROM b)"""


@query("ohlc_repair", f"""{_DIRTY} SELECT symbol, datetime, open, greatest(high, low, open, close) AS high, least(high, low, open, close) AS low, close, greatest(volume, 0) AS volume
FROM x WHERE open > 0 AND high > 0 AND low > 0 AND close > 0""")  # fmt: skip
def ohlc_repair(spark, d):
    return clean.repair(_dirty(spark, d))


@query("ohlc_repair_report", whole(f"""{_DIRTY} SELECT count_if(high < low) AS inverted, count_if(greatest(high, low) < open) AS high_open, count_if(greatest(high, low, open) < close) AS high_close, count_if(least(high, low) > open) AS low_open,
  count_if(least(high, low, open) > close) AS low_close, count_if(least(open, high, low, close) <= 0) AS not_positive, count_if(volume < 0 AND least(open, high, low, close) > 0) AS negative_volume FROM x""", "inverted", "high_open", "high_close", "low_open", "low_close", "not_positive", "negative_volume"))  # fmt: skip
def ohlc_repair_report(spark, d):
    return clean.repair_report(_dirty(spark, d)).select(*[F.col(c).cast("long").alias(c) for c in ("inverted", "high_open", "high_close", "low_open", "low_close", "not_positive", "negative_volume")])


@query("schema_violations", whole(f"""{_DIRTY} SELECT * FROM (SELECT 'missing' AS name, count_if(datetime IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS n FROM x UNION ALL
SELECT 'not_positive', count_if(least(open, high, low, close) <= 0 OR volume <= 0) FROM x UNION ALL SELECT 'high_below', count_if(high < greatest(open, low, close)) FROM x UNION ALL
SELECT 'low_above', count_if(low > least(open, high, close)) FROM x UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT (symbol, datetime)) FROM x)""", "n"))  # fmt: skip
def schema_violations(spark, d):
    return clean.schema_violations(_dirty(spark, d)).select("name", F.col("n").cast("long").alias("n"))


_TICKS = "t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS datetime, event_id, value AS price FROM events WHERE value > 0)"


def _ticks(spark, d):
    return ev_ticks(spark, d).select("symbol", resample.time_bucket("datetime", 60).alias("datetime"), "event_id", "price")


@query("dedupe_first", f"WITH {_TICKS} SELECT symbol, datetime, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, datetime ORDER BY event_id) AS rn FROM t) WHERE rn = 1")
def dedupe_first(spark, d):
    return clean.dedupe(_ticks(spark, d), ["event_id"])


@query("duplicate_report", f"WITH {_TICKS}, n AS (SELECT symbol, datetime, count(*) AS n FROM t GROUP BY ALL) SELECT symbol, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 6) AS pct FROM n GROUP BY symbol")
def duplicate_report(spark, d):
    return rounded(clean.duplicate_report(_ticks(spark, d)))


_GAP = f"{ev_bars_sql(60)}, g AS (SELECT symbol, lag(datetime) OVER ({W}) AS gap_start, datetime AS gap_end FROM b), w AS (SELECT *, epoch(gap_end - gap_start) / 60 AS m FROM g)"


@query("gap_report", f"WITH {_GAP} SELECT symbol, gap_start, gap_end, m::DOUBLE AS gap_minutes FROM w WHERE m > 120")
def gap_report(spark, d):
    return clean.gaps(ev_bars(spark, d, 60), 60)


def _chi(t: str) -> str:
    return f"(({t} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


_EXP = f"((isodow({_chi('gap_start')}) = 5 AND hour({_chi('gap_start')}) >= 16 AND isodow({_chi('gap_end')}) IN (7, 1)) OR ({_chi('gap_start')}::DATE = {_chi('gap_end')}::DATE AND hour({_chi('gap_start')}) <= 16 AND hour({_chi('gap_end')}) >= 17))"


@query("gap_calendar", f"WITH {_GAP} SELECT symbol, gap_start, gap_end, (floor(m / 60) - 1)::BIGINT AS missing_bars, {_EXP} AS expected FROM w WHERE m > 60")
def gap_calendar(spark, d):
    return clean.calendar_gaps(ev_bars(spark, d, 60), 60)


@query("gap_completeness", f"""WITH {_GAP}, c AS (SELECT symbol, floor(m / 60) - 1 AS k, {_EXP} AS e FROM w WHERE m > 60), s AS (SELECT symbol, sum(k) AS missing, sum(CASE WHEN e THEN 0 ELSE k END) AS unexpected FROM c GROUP BY symbol), n AS (SELECT symbol, count(*) AS rows FROM b GROUP BY symbol)
SELECT symbol, rows, coalesce(missing, 0)::BIGINT AS missing, coalesce(unexpected, 0)::BIGINT AS unexpected, round(rows * 100.0 / (rows + coalesce(unexpected, 0)), 6) AS completeness FROM n LEFT JOIN s USING (symbol)""")  # fmt: skip
def gap_completeness(spark, d):
    return rounded(clean.completeness(ev_bars(spark, d, 60), 60))


_GRID = f"""{ev_bars_sql(15)}, e AS (SELECT symbol, min(datetime) AS lo, max(datetime) AS hi FROM b GROUP BY symbol), grid AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS datetime FROM e)"""
_FFILL = lambda c, n: f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query("grid_ffill_limit", f"""WITH {_GRID}, j AS (SELECT g.symbol, g.datetime, open, high, low, close, volume FROM grid g LEFT JOIN b USING (symbol, datetime)),
f AS (SELECT symbol, datetime, {", ".join(f"{_FFILL(c, 4)} AS {c}" for c in ("open", "high", "low", "close", "volume"))}, CASE WHEN close IS NULL THEN 1 ELSE 0 END AS missing_bar FROM j)
SELECT symbol, datetime, {_OHLC}, round(volume, 6) AS volume, missing_bar FROM f WHERE close IS NOT NULL""")  # fmt: skip
def grid_ffill_limit(spark, d):
    return rounded(clean.fill_simple(ev_bars(spark, d, 15), 15, 4))


@query("gap_fill_calendar", f"""WITH {_GRID}, o AS (SELECT * FROM grid WHERE NOT ((isodow({_chi('datetime')}) = 5 AND hour({_chi('datetime')}) >= 16) OR isodow({_chi('datetime')}) = 6 OR (isodow({_chi('datetime')}) = 7 AND hour({_chi('datetime')}) < 17) OR hour({_chi('datetime')}) = 16)),
j AS (SELECT g.symbol, g.datetime, open, high, low, close, volume FROM o g LEFT JOIN b USING (symbol, datetime)),
f AS (SELECT symbol, datetime, {", ".join(f"{_FFILL(c, 3)} AS {c}" for c in ("open", "high", "low", "close"))}, coalesce(volume, 0) AS volume, CASE WHEN close IS NULL THEN 1 ELSE 0 END AS filled FROM j)
SELECT symbol, datetime, {_OHLC}, round(volume, 6) AS volume, filled FROM f WHERE close IS NOT NULL""")  # fmt: skip
def gap_fill_calendar(spark, d):
    return rounded(clean.fill(ev_bars(spark, d, 15), 15, 3))


@query("zscore_outliers", f"WITH {LI_BARS_SQL}, s AS (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS sd FROM b GROUP BY symbol) SELECT symbol, datetime, coalesce(abs(volume - m) / nullif(sd, 0) > 2.5, false) AS outlier FROM b JOIN s USING (symbol)")
def zscore_outliers(spark, d):
    return clean.zscore_outliers(li_bars(spark, d), "volume", 2.5).select("symbol", "datetime", "outlier")


@query("iqr_outliers", f"WITH {LI_BARS_SQL}, s AS (SELECT symbol, quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.75) AS z FROM b GROUP BY symbol) SELECT symbol, datetime, volume < a - 1.5 * (z - a) OR volume > z + 1.5 * (z - a) AS outlier FROM b JOIN s USING (symbol)")
def iqr_outliers(spark, d):
    return clean.iqr_outliers(li_bars(spark, d), "volume", 1.5).select("symbol", "datetime", "outlier")


@query("roll_window_flags", f"""WITH {LI_BARS_SQL}, e AS (SELECT *, CAST(coalesce(abs(close / nullif(lag(close) OVER ({W}), 0) - 1) >= 0.3, false) AS INTEGER) AS roll_event FROM b)
SELECT symbol, datetime, roll_event, max(roll_event) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS roll_window FROM e""")  # fmt: skip
def roll_window_flags(spark, d):
    return clean.roll_flags(li_bars(spark, d), 0.3).select("symbol", "datetime", "roll_event", "roll_window")


@query("clean_pipeline")
def clean_pipeline(spark, d):
    return rounded(clean.clean(ev_bars(spark, d, 1).withColumn("volume", F.col("volume").cast("long")), 5))


@query("nan_audit", f"WITH {LI_BARS_SQL}, x AS (SELECT lag(close, 20) OVER ({W}) AS l20, close FROM b) SELECT 'l20' AS name, round(count_if(l20 IS NULL) / count(*), 6) AS rate FROM x UNION ALL SELECT 'close', round(count_if(close IS NULL) / count(*), 6) FROM x")
def nan_audit(spark, d):
    r = Rolling.of_blocks()
    return rounded(clean.nan_audit(with_features(li_bars(spark, d), {"l20": r.lag(F.col("close"), 20)}, 20), ["l20", "close"]))


_M = "(hour(datetime) * 60 + minute(datetime))"
_IN = {"new_york": f"({_M} >= 870 AND {_M} < 1260)", "london": f"({_M} >= 480 AND {_M} < 990)", "asia": f"({_M} >= 1380 OR {_M} < 420)"}


@query("session_flags", f"""WITH {ev_bars_sql(30)} SELECT symbol, datetime, {", ".join(f"CAST({e} AS INTEGER) AS is_{s}" for s, e in _IN.items())}, CASE WHEN {_IN['asia']} THEN 'asia' WHEN {_IN['london']} THEN 'london' WHEN {_IN['new_york']} THEN 'new_york' ELSE 'outside' END AS session_id,
  coalesce(CASE WHEN {_IN['new_york']} THEN 'new_york' WHEN {_IN['london']} THEN 'london' WHEN {_IN['asia']} THEN 'asia' END, 'outside') AS first_session, CAST({_M} >= 870 AND {_M} < 990 AS INTEGER) AS london_ny, CAST({_M} >= 480 OR {_M} < 420 AS INTEGER) AS asia_london FROM b""")  # fmt: skip
def session_flags(spark, d):
    cols = clock.session_flags() | {"session_id": clock.session_id(), "first_session": F.coalesce(clock.session(first_wins=True), F.lit("outside"))} | clock.overlap_flags()
    return ev_bars(spark, d, 30).select("symbol", "datetime", *[c.alias(n) for n, c in cols.items()])


@query("session_stats", f"""WITH {ev_bars_sql(30)}, x AS (SELECT datetime, CASE WHEN {_IN['asia']} THEN 'asia' WHEN {_IN['london']} THEN 'london' WHEN {_IN['new_york']} THEN 'new_york' ELSE 'outside' END AS session FROM b)
SELECT session, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM x), 6) AS pct, min(datetime) AS first_time, max(datetime) AS last_time FROM x GROUP BY session""")  # fmt: skip
def session_stats(spark, d):
    return rounded(clock.session_stats(ev_bars(spark, d, 30)))


@query("session_filter", f"WITH {ev_bars_sql(30)} SELECT symbol, datetime FROM b WHERE {_IN['new_york']} OR {_IN['asia']}")
def session_filter(spark, d):
    return clock.in_sessions(ev_bars(spark, d, 30), exclude=["london"]).select("symbol", "datetime")


_CYC = {f"{n}_{f}": f"{f}({v} * 2 * pi() / {k})" for n, v, k in (("hour", "hour(datetime)", 24), ("minute", "minute(datetime)", 60), ("dayofweek", "(isodow(datetime) - 1)", 7)) for f in ("sin", "cos")}


@query("cyclical_time", f"WITH {ev_bars_sql(30)} SELECT symbol, datetime, {', '.join(f'round({e}, 6) AS {k}' for k, e in _CYC.items())}, CAST(hour(datetime) < 8 AS INTEGER) AS session_asia, CAST(hour(datetime) BETWEEN 8 AND 15 AS INTEGER) AS session_london, CAST(hour(datetime) >= 16 AS INTEGER) AS session_ny FROM b")
def cyclical_time(spark, d):
    return rounded(ev_bars(spark, d, 30).select("symbol", "datetime", *[c.alias(n) for n, c in clock.cyclical().items()]))


@query("dst_flags", f"""WITH {LI_BARS_SQL}, x AS (SELECT symbol, datetime, ((datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS ny FROM b)
SELECT symbol, datetime, CAST(epoch(ny - datetime) > -18000 AS INTEGER) AS is_dst, CAST((month(ny) = 3 AND isodow(ny) = 7 AND day(ny) BETWEEN 8 AND 14) OR (month(ny) = 11 AND isodow(ny) = 7 AND day(ny) <= 7) AS INTEGER) AS is_dst_transition FROM x""")  # fmt: skip
def dst_flags(spark, d):
    return li_bars(spark, d).select("symbol", "datetime", *[c.alias(n) for n, c in clock.dst().items()])


@query("mtf_asof", f"""WITH {ev_bars_sql(15)}, h AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, datetime, TIMESTAMP '1970-01-01') AS datetime, {_RS.replace('datetime)', 'b.datetime)')} FROM b GROUP BY ALL),
m AS (SELECT symbol, datetime, lag(close) OVER ({W}) AS close_4h, lag(volume) OVER ({W}) AS volume_4h FROM h)
SELECT b.symbol, b.datetime, round(b.close, 6) AS close, round(m.close_4h, 6) AS close_4h, round(m.volume_4h, 6) AS volume_4h FROM b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.datetime >= m.datetime""")  # fmt: skip
def mtf_asof(spark, d):
    base = ev_bars(spark, d, 15)
    mtf = resample.resample(base, 240).select("symbol", "datetime", F.col("close").alias("close_4h"), F.col("volume").alias("volume_4h"))
    return rounded(resample.as_of(base.select("symbol", "datetime", "close"), mtf, ["close_4h", "volume_4h"]))


