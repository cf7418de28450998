"""Label, split, fold and stacking queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import labels, splits
from ..series import Rolling, indexed, with_features
from ..sources.bars import LI_BARS_SQL, li_bars
from .registry import query, rounded, whole

W = "PARTITION BY symbol ORDER BY datetime"
#: A 14-bar mean of high - low stands for the ATR here: it has a plain SQL form.
_RANGE = f"CASE WHEN count(high) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14 THEN avg(high - low) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END"


def _bars(spark, d):
    r = Rolling.of_blocks()
    return with_features(li_bars(spark, d), {"atr_14": r.mean(F.col("high") - F.col("low"), 14)}, 14)


def _scan_sql(up: str, dn: str, ok: str, n: int, h: int, tie: str, names: tuple[str, str], limit: str | None = None, extra: str = "") -> str:
    """The scan over the next n bars as lists."""
    both = "-99" if tie == "invalid" else "(CASE WHEN abs(fut[u].open - up) <= abs(fut[u].open - dn) THEN 1 ELSE -1 END)"
    lim = limit or str(n)
    return f"""WITH {LI_BARS_SQL}, a AS (SELECT *, {_RANGE} AS atr_14 {extra} FROM b),
f AS (SELECT *, {up} AS up, {dn} AS dn, coalesce({ok}, false) AS ok, ({lim}) AS mb, list({{'high': high, 'low': low, 'open': open}}) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS fut0,
  count(*) OVER (PARTITION BY symbol) - row_number() OVER ({W}) < {n} AS tail FROM a),
g0 AS (SELECT *, fut0[1:mb] AS fut FROM f),
g AS (SELECT *, list_min([i FOR i IN range(1, len(fut) + 1) IF fut[i].high >= up]) AS u, list_min([i FOR i IN range(1, len(fut) + 1) IF fut[i].low <= dn]) AS d FROM g0),
x AS (SELECT *, CASE WHEN tail THEN 0 WHEN ok THEN coalesce(least(u, d), mb) ELSE mb END AS bars FROM g),
y AS (SELECT *, list_min([z.low FOR z IN fut[1:bars]]) AS lo, list_max([z.high FOR z IN fut[1:bars]]) AS hi FROM x),
l AS (SELECT symbol, datetime, open, high, low, close, volume, atr_14,
  CAST(CASE WHEN tail THEN -99 WHEN NOT ok THEN 0 WHEN u IS NULL AND d IS NULL THEN 0 WHEN u = d THEN {both} WHEN d IS NULL OR u < d THEN 1 ELSE -1 END AS INTEGER) AS label_h{h}, CAST(bars AS INTEGER) AS bars_to_hit_h{h},
  CASE WHEN NOT tail AND ok THEN least((lo - close) / close, 0) ELSE 0 END AS {names[0]}_h{h}, CASE WHEN NOT tail AND ok THEN greatest((hi - close) / close, 0) ELSE 0 END AS {names[1]}_h{h},
  CAST(CASE WHEN tail OR NOT ok OR (u IS NULL AND d IS NULL) OR u = d THEN 0 WHEN d IS NULL OR u < d THEN 1 ELSE -1 END AS INTEGER) AS touch_type_h{h} FROM y)"""


def _out(h: int, names=("mae", "mfe")) -> str:
    return f"SELECT symbol, datetime, label_h{h}, bars_to_hit_h{h}, round({names[0]}_h{h}, 6) AS {names[0]}_h{h}, round({names[1]}_h{h}, 6) AS {names[1]}_h{h}, touch_type_h{h} FROM l"


def _pick(df, h: int, names=("mae", "mfe")):
    return rounded(df.select("symbol", "datetime", *[f"{c}_h{h}" for c in ("label", "bars_to_hit", *names, "touch_type")]))


_TB = _scan_sql("close + 1.0 * atr_14", "close - 1.0 * atr_14", "atr_14 > 0", 15, 5, "invalid", ("mae", "mfe"))


@query("triple_barrier", f"{_TB} {_out(5)}")
def triple_barrier(spark, d):
    return _pick(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5)


@query("triple_barrier_costs", _scan_sql("close + (1.0 + coalesce(400 * 0.25 / md, 0)) * atr_14", "close - 1.0 * atr_14", "atr_14 > 0", 10, 5, "invalid", ("mae", "mfe")).replace("\nf AS (SELECT *,", "\nmd AS (SELECT symbol, quantile_cont(atr_14, 0.5) AS md FROM a WHERE atr_14 > 0 GROUP BY symbol), am AS (SELECT a.*, md FROM a LEFT JOIN md USING (symbol)),\nf AS (SELECT *,").replace("AS tail FROM a)", "AS tail FROM am)") + _out(5))
def triple_barrier_costs(spark, d):
    return _pick(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 10, cost_ticks=400), 5)


@query("adaptive_barrier", _scan_sql("close + (CASE WHEN day(datetime) % 2 = 0 THEN 0.6 ELSE 0.9 END) * atr_14", "close - 0.7 * atr_14", "atr_14 > 0", 12, 5, "distance", ("mae", "mfe"), "CASE WHEN day(datetime) % 3 = 0 THEN 6 ELSE 12 END") + _out(5))
def adaptive_barrier(spark, d):
    b = _bars(spark, d).withColumns({"ku": F.when(F.day("datetime") % 2 == 0, 0.6).otherwise(0.9), "kd": F.lit(0.7), "mb": F.when(F.day("datetime") % 3 == 0, 6).otherwise(12)})
    return _pick(labels.adaptive_barrier(b, 5, "ku", "kd", "mb", 12), 5)


@query("threshold_label", _scan_sql("close * (1 + 0.4)", "close * (1 - 0.3)", "close > 0", 10, 5, "distance", ("max_loss", "max_gain")) + _out(5, ("max_loss", "max_gain")))
def threshold_label(spark, d):
    return _pick(labels.threshold(_bars(spark, d), 5, 0.4, 0.3, 10), 5, ("max_loss", "max_gain"))


_FWD = f"WITH {LI_BARS_SQL}, f AS (SELECT *, lead(close, 5) OVER ({W}) / nullif(close, 0) AS q FROM b)"


@query("directional", f"{_FWD} SELECT symbol, datetime, CAST(CASE WHEN q IS NULL THEN -99 WHEN q - 1 > 0.01 THEN 1 WHEN q - 1 < -0.01 THEN -1 ELSE 0 END AS INTEGER) AS label_h5, round(q - 1, 6) AS fwd_return_h5 FROM f")
def directional(spark, d):
    return rounded(labels.directional(li_bars(spark, d), 5, 0.01).select("symbol", "datetime", "label_h5", "fwd_return_h5"))


@query("regression_winsor", f"{_FWD}, p AS (SELECT symbol, quantile_cont(q - 1, 0.01) AS lo, quantile_cont(q - 1, 0.99) AS hi FROM f GROUP BY symbol) SELECT symbol, datetime, round(greatest(least(q - 1, hi), lo) + q * 0, 6) AS target_h5, CAST(CASE WHEN q IS NULL THEN -99 ELSE 0 END AS INTEGER) AS label_h5 FROM f JOIN p USING (symbol)")
def regression_winsor(spark, d):
    return rounded(labels.regression(li_bars(spark, d), 5).select("symbol", "datetime", "target_h5", "label_h5"))


@query("regression_metrics", f"""{_FWD}, r AS (SELECT symbol, q - 1 AS r FROM f WHERE q IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max, {", ".join(f"round(quantile_cont(r, {p}), 6) AS {k}" for k, p in (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))},
  round(skewness(r) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew, round(kurtosis_pop(r), 6) AS kurtosis, round(count_if(r > 0) * 100.0 / count(*), 6) AS positive_pct FROM r GROUP BY symbol""")  # fmt: skip
def regression_metrics(spark, d):
    return rounded(labels.regression_metrics(labels.forward_returns(li_bars(spark, d), 5), "fwd_return_h5"))


@query("meta_label", f"{_FWD}, s AS (SELECT *, CASE day(datetime) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS sg FROM f) SELECT symbol, datetime, CAST(CASE WHEN sg = 0 OR q IS NULL THEN -99 WHEN (q - 1) * sg > 0 THEN 1 ELSE 0 END AS INTEGER) AS meta_label_h5, round(CASE WHEN sg <> 0 THEN (q - 1) * sg END, 6) AS margin_h5, round(CASE WHEN sg <> 0 THEN abs((q - 1) * sg) END, 6) AS bet_size_h5 FROM s")
def meta_label(spark, d):
    k = F.day("datetime") % 3
    b = li_bars(spark, d).withColumn("sg", F.when(k == 0, 0).when(k == 1, 1).otherwise(-1))
    return rounded(labels.meta(b, 5, "sg").select("symbol", "datetime", "meta_label_h5", "margin_h5", "bet_size_h5"))


@query("label_metrics", whole(f"""{_TB}, v AS (SELECT *, label_h5 <> -99 AS k FROM l) SELECT symbol, count_if(k) AS n_valid, count_if(NOT k) AS n_invalid, {", ".join(f"count_if(label_h5 = {v}) AS n_{n}, round(count_if(label_h5 = {v}) * 100.0 / nullif(count_if(k), 0), 6) AS pct_{n}" for n, v in (("short", -1), ("neutral", 0), ("long", 1)))},
  round(avg(mae_h5) FILTER (k), 6) AS avg_mae, round(avg(mfe_h5) FILTER (k), 6) AS avg_mfe, round(avg(mfe_h5) FILTER (k) / nullif(abs(avg(mae_h5) FILTER (k)), 0), 6) AS mfe_mae_ratio, round(avg(bars_to_hit_h5) FILTER (k AND bars_to_hit_h5 > 0), 6) AS avg_bars FROM v GROUP BY symbol""", "n_valid", "n_invalid", "n_short", "n_neutral", "n_long"))  # fmt: skip
def label_metrics(spark, d):
    return rounded(labels.label_metrics(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5))


@query("label_report", f"{_TB} SELECT symbol, 5 AS horizon, label_h5 AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol), 6) AS pct FROM l GROUP BY symbol, label_h5")
def label_report(spark, d):
    return rounded(labels.report(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), [5]))


_QUAL = f"""{_TB}, q0 AS (SELECT *, CASE WHEN label_h5 = -1 THEN abs(mfe_h5) ELSE abs(mae_h5) END AS risk, CASE WHEN label_h5 = -1 THEN abs(mae_h5) ELSE abs(mfe_h5) END AS gain FROM l),
q1 AS (SELECT *, risk / nullif(gain, 0) AS pg, risk * sqrt(bars_to_hit_h5) AS dd FROM q0),
q2 AS (SELECT symbol, {", ".join(f"quantile_cont({c}, 0.95) FILTER ({c} > 0) AS p_{c}" for c in ("risk", "gain", "pg", "dd"))} FROM q1 WHERE label_h5 <> -99 GROUP BY symbol),
q3 AS (SELECT q1.*, 0.20 * exp(-pow((bars_to_hit_h5 - 7.5) / 7.5, 2) / 2) + 0.25 * (1 - coalesce(least(risk / nullif(p_risk, 0), 1), 0)) + 0.20 * coalesce(least(gain / nullif(p_gain, 0), 1), 0) + 0.20 * (1 - coalesce(CASE WHEN pg IS NULL THEN NULL ELSE least(pg / nullif(p_pg, 0), 1) END, 1)) + 0.15 * (1 - coalesce(least(dd / nullif(p_dd, 0), 1), 0)) AS quality FROM q1 LEFT JOIN q2 USING (symbol)),
q4 AS (SELECT symbol, quantile_cont(quality, 0.2) AS a, quantile_cont(quality, 0.8) AS z FROM q3 GROUP BY symbol)"""


@query("quality_scores", f"{_QUAL} SELECT symbol, datetime, round(quality, 6) AS quality_h5, round(pg, 6) AS pain_to_gain_h5, round(dd, 6) AS time_weighted_dd_h5 FROM q3")
def quality_scores(spark, d):
    q = labels.quality(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5)
    return rounded(q.select("symbol", "datetime", "quality_h5", "pain_to_gain_h5", "time_weighted_dd_h5"))


@query("sample_weights", whole(f"{_QUAL} SELECT symbol, count_if(quality >= z) AS high, count_if(quality >= a AND quality < z) AS mid, count_if(quality < a) AS low FROM q3 JOIN q4 USING (symbol) GROUP BY symbol", "high", "mid", "low"))
def sample_weights(spark, d):
    w = labels.weights(labels.quality(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5), 5)
    n = lambda x: F.count_if(F.col("sample_weight_h5") == x)
    return w.groupBy("symbol").agg(n(1.5).alias("high"), n(1.0).alias("mid"), n(0.5).alias("low"))


@query("forward_returns", f"{_FWD} SELECT symbol, datetime, round(CASE WHEN q > 0 THEN q - 1 END, 6) AS fwd_return_h5, round(CASE WHEN q > 0 THEN ln(q) END, 6) AS fwd_return_log_h5 FROM f")
def forward_returns(spark, d):
    return rounded(labels.forward_returns(li_bars(spark, d), 5).select("symbol", "datetime", "fwd_return_h5", "fwd_return_log_h5"))


@query("label_end_times", f"{_TB}, n AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS k FROM l) SELECT n.symbol, n.datetime, m.datetime AS label_end_time_h5 FROM n JOIN n m ON m.symbol = n.symbol AND m.i = least(n.i + n.bars_to_hit_h5, n.k)")
def label_end_times(spark, d):
    return labels.end_times(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5, 15).select("symbol", "datetime", "label_end_time_h5")


@query("final_labels")
def final_labels(spark, d):
    return rounded(labels.final_labels(_bars(spark, d), 5, 1.0, 1.0, 15))


_POS = f"{LI_BARS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, count(*) OVER () AS n FROM b)"


def _ordered(spark, d):
    return li_bars(spark, d).select("datetime", "symbol", "close")


_CHRONO = f"""WITH {_POS}, s AS (SELECT *, CASE WHEN row_id < floor(n * 0.7) - 60 THEN 'train' WHEN row_id >= floor(n * 0.7) + 30 AND row_id < floor(n * 0.85) - 60 THEN 'val' WHEN row_id >= floor(n * 0.85) + 30 THEN 'test' END AS split FROM p)"""


def _chrono(spark, d):
    return splits.chronological(_ordered(spark, d), purge=60, embargo=30)


@query("chrono_split", f"{_CHRONO} SELECT symbol, datetime, row_id, split FROM s WHERE split IS NOT NULL")
def chrono_split(spark, d):
    return _chrono(spark, d).select("symbol", "datetime", F.col("row_id").cast("long").alias("row_id"), "split")


@query("split_symbol_shares", f"{_CHRONO} SELECT split, symbol, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM s WHERE split IS NOT NULL GROUP BY split, symbol")
def split_symbol_shares(spark, d):
    return rounded(splits.symbol_shares(_chrono(spark, d)))


@query("split_label_shares", f"{_CHRONO}, y AS (SELECT split, CAST(day(datetime) % 3 - 1 AS INTEGER) AS label FROM s WHERE split IS NOT NULL) SELECT split, label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM y GROUP BY split, label")
def split_label_shares(spark, d):
    return rounded(splits.label_shares(_chrono(spark, d).withColumn("y", (F.day("datetime") % 3 - 1).cast("int")), "y"))


def _fold_sql(table: str, end: bool = True) -> str:
    """table: fold, a, z (test), and train ranges as rows (fold, lo, hi)."""
    purge = ""
    if end:
        purge = ", t AS (SELECT k.fold, k.a, min(e.datetime) AS t0, max(e.datetime) AS t1 FROM k JOIN e ON e.row_id = k.a OR e.row_id = k.z - 1 GROUP BY ALL)"
    keep = "WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.fold = r.fold AND e.stop >= t.t0 AND e.datetime <= t.t1)" if end else ""
    return f"""WITH {_POS}, e AS (SELECT row_id, n, datetime, datetime + INTERVAL 5 DAY AS stop FROM p), {table}{purge}
SELECT DISTINCT e.row_id, k.fold, 'test' AS role FROM e JOIN k ON e.row_id >= k.a AND e.row_id < k.z UNION ALL SELECT DISTINCT e.row_id, r.fold, 'train' AS role FROM e JOIN r ON e.row_id >= r.lo AND e.row_id < r.hi {keep}"""


_N = "(SELECT max(n) FROM p)"
_KF = f"k AS (SELECT CAST(i AS INTEGER) AS fold, i * (N.n // 5) AS a, CASE WHEN i = 4 THEN N.n ELSE (i + 1) * (N.n // 5) END AS z FROM range(5) t(i), (SELECT max(n) AS n FROM p) N), r AS (SELECT fold, 0 AS lo, greatest(0, a - 60) AS hi FROM k UNION ALL SELECT fold, z + 30, {_N} FROM k)"


def _with_end(spark, d):
    return _ordered(spark, d).withColumn("stop", F.col("datetime") + F.expr("INTERVAL 5 DAYS"))


def _typed(df):
    return df.select(F.col("row_id").cast("long").alias("row_id"), "fold", "role")


@query("purged_folds", _fold_sql(_KF))
def purged_folds(spark, d):
    return _typed(splits.purged_kfold(_with_end(spark, d), 5, 60, 30, "stop"))


@query("fold_info", f"WITH f AS ({_fold_sql(_KF)}) SELECT fold, role, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM f GROUP BY fold, role")
def fold_info(spark, d):
    return splits.fold_info(purged_folds(spark, d))


_PATHS = list(combinations(range(6), 2))
_CP = f"""c(fold, g) AS (VALUES {", ".join(f"({i}, {g})" for i, p in enumerate(_PATHS) for g in p)}), N AS (SELECT max(n) AS n FROM p), k AS (SELECT CAST(fold AS INTEGER) AS fold, g * (n // 6) AS a, CASE WHEN g = 5 THEN n ELSE (g + 1) * (n // 6) END AS z FROM c, N)"""


@query("cpcv_paths", f"""WITH {_POS}, {_CP}, e AS (SELECT row_id, n, datetime FROM p)
SELECT e.row_id, k.fold, 'test' AS role FROM e JOIN k ON e.row_id >= k.a AND e.row_id < k.z UNION ALL
SELECT e.row_id, CAST(f.fold AS INTEGER), 'train' FROM e, (SELECT DISTINCT fold FROM k) f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.fold = f.fold AND e.row_id >= k.a - floor(e.n * 0.01) AND e.row_id < k.z + floor(e.n * 0.01))""")  # fmt: skip
def cpcv_paths(spark, d):
    return _typed(splits.cpcv(_ordered(spark, d)))


@query("fold_coverage", f"WITH {_POS}, {_CP}, t AS (SELECT row_id, count(*) AS times FROM p JOIN k ON row_id >= a AND row_id < z GROUP BY row_id) SELECT times, count(*) AS n, round(count(*) / {_N}, 6) AS share FROM t GROUP BY times")
def fold_coverage(spark, d):
    b = _ordered(spark, d)
    return rounded(splits.coverage(splits.cpcv(b), b.count()))


_WF = f"N AS (SELECT max(n) AS n, CAST(floor(max(n) * 0.4) AS BIGINT) AS s FROM p), k AS (SELECT CAST(i AS INTEGER) AS fold, s + i * ((n - s) // 5) AS a, CASE WHEN i = 4 THEN n ELSE s + (i + 1) * ((n - s) // 5) END AS z FROM range(5) t(i), N), r AS (SELECT fold, 0 AS lo, a - 60 AS hi FROM k)"


@query("walk_forward", _fold_sql(_WF))
def walk_forward(spark, d):
    return _typed(splits.walk_forward(_with_end(spark, d), 5, label_end="stop"))


_SEQ = f"""WITH {LI_BARS_SQL}, s AS (SELECT *, row_number() OVER ({W}) - 1 AS i, epoch(datetime - lag(datetime) OVER ({W})) AS st FROM b), m AS (SELECT symbol, quantile_cont(st, 0.5) AS md FROM s GROUP BY symbol),
j AS (SELECT s.*, CAST(coalesce(st > 2 * md, false) AS INTEGER) AS jump FROM s JOIN m USING (symbol)),
q AS (SELECT *, list(close) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS xs, sum(jump) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS broken FROM j)"""


@query("sequence_targets", f"{_SEQ} SELECT symbol, datetime, round(list_sum(list_transform(xs, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 3) AS total, len(xs)::INTEGER AS length FROM q WHERE len(xs) = 8 AND broken = 0 AND (i - 7) % 2 = 0")
def sequence_targets(spark, d):
    s = splits.sequences(li_bars(spark, d), ["close"], 8, stride=2)
    return s.select("symbol", "datetime", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0].cast("double")), 3).alias("total"), F.size("sequence").alias("length"))


@query("multi_resolution")
def multi_resolution(spark, d):
    return splits.multi_resolution(li_bars(spark, d), {"base": ["open", "high", "low", "close"], "vol": ["volume"]}, 6)


_PRED = "SELECT o_orderkey AS row_id, CAST(o_orderkey % 3 AS INTEGER) AS y, " + ", ".join(
    f"((o_custkey * {a + 3 * m} + o_orderkey * {k + 2}) % 97 + 1e0) / (((o_custkey * {a + 3 * m} + o_orderkey * 2) % 97 + 1e0) + ((o_custkey * {a + 3 * m} + o_orderkey * 3) % 97 + 1e0) + ((o_custkey * {a + 3 * m} + o_orderkey * 4) % 97 + 1e0)) AS m{m}_p{k}"
    for m, a in ((0, 5), (1, 7), (2, 11))
    for k in range(3)
)


def predictions(spark, d):
    """Three models' class probabilities for every order, made by rule."""
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("_orders")
    return spark.sql(f"{_PRED} FROM _orders")


PREDICTIONS_SQL = f"{_PRED} FROM orders"
_ARG = lambda m: f"(list_position([{m}_p0, {m}_p1, {m}_p2], greatest({m}_p0, {m}_p1, {m}_p2)) - 1)"
_MS = ("m0", "m1", "m2")


@query("stacking_features", f"""WITH x AS ({PREDICTIONS_SQL}), a AS (SELECT *, {", ".join(f"{_ARG(m)} AS a{m}, greatest({m}_p0, {m}_p1, {m}_p2) AS c{m}, -({' + '.join(f'{m}_p{k} * ln({m}_p{k} + 1e-10)' for k in range(3))}) AS e{m}" for m in _MS)}, {", ".join(f"(m0_p{k} + m1_p{k} + m2_p{k}) / 3 AS q{k}" for k in range(3))} FROM x),
c AS (SELECT *, greatest({", ".join(f"CAST(am0 = {k} AS INTEGER) + CAST(am1 = {k} AS INTEGER) + CAST(am2 = {k} AS INTEGER)" for k in range(3))}) AS n, (am0 + am1 + am2) / 3.0 AS mu FROM a)
SELECT row_id, CAST(n = 3 AS INTEGER) AS models_agree, CAST(n AS INTEGER) AS agreement_count, round((cm0 + cm1 + cm2) / 3, 6) AS avg_confidence, round(least(cm0, cm1, cm2), 6) AS min_confidence, round(greatest(cm0, cm1, cm2), 6) AS max_confidence,
  round(-(q0 * ln(q0 + 1e-10) + q1 * ln(q1 + 1e-10) + q2 * ln(q2 + 1e-10)), 6) AS prediction_entropy, round((em0 + em1 + em2) / 3, 6) AS avg_entropy, round(sqrt((pow(am0 - mu, 2) + pow(am1 - mu, 2) + pow(am2 - mu, 2)) / 2), 6) AS prediction_std FROM c""")  # fmt: skip
def stacking_features(spark, d):
    cols = ("models_agree", "agreement_count", "avg_confidence", "min_confidence", "max_confidence", "prediction_entropy", "avg_entropy", "prediction_std")
    return rounded(splits.stacking_features(predictions(spark, d), list(_MS)).select("row_id", *cols))


_HALVES = list(combinations(range(4), 2))


@query("pbo", f"""WITH x AS ({PREDICTIONS_SQL}), perf AS (SELECT CAST(row_id % 8 AS INTEGER) AS path, s AS strategy, avg(CASE s WHEN 'm0' THEN m0_p0 WHEN 'm1' THEN m1_p0 ELSE m2_p0 END) AS perf FROM x, (VALUES ('m0'), ('m1'), ('m2')) t(s) GROUP BY ALL),
c(combo, part) AS (VALUES {", ".join(f"({i}, {p})" for i, c in enumerate(_HALVES) for p in c)}), n AS (SELECT DISTINCT combo FROM c),
m AS (SELECT CAST(n.combo AS INTEGER) AS combo, strategy, avg(perf) FILTER (c.part IS NOT NULL) AS is_perf, avg(perf) FILTER (c.part IS NULL) AS oos_perf FROM perf CROSS JOIN n LEFT JOIN c ON c.combo = n.combo AND c.part = path // 2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY is_perf DESC, strategy) AS b, rank() OVER (PARTITION BY combo ORDER BY oos_perf) + (count(*) OVER (PARTITION BY combo, oos_perf) - 1) / 2 AS rk FROM m)
SELECT combo, strategy, round(is_perf, 6) AS is_perf, round(oos_perf, 6) AS oos_perf, round(rk / 4, 6) AS relative_rank, round(ln((rk / 4) / (1 - rk / 4)), 6) AS logit FROM k WHERE b = 1""")  # fmt: skip
def pbo(spark, d):
    x = predictions(spark, d)
    s = F.explode(F.array(*[F.struct(F.lit(m).alias("strategy"), F.col(f"{m}_p0").alias("p")) for m in _MS])).alias("e")
    perf = x.select((F.col("row_id") % 8).cast("int").alias("path"), s).groupBy("path", "e.strategy").agg(F.avg("e.p").alias("perf"))
    return rounded(splits.pbo(perf, 4))


@query("row_index", f"WITH {LI_BARS_SQL} SELECT symbol, datetime, row_number() OVER ({W}) - 1 AS idx FROM b")
def row_index(spark, d):
    return indexed(li_bars(spark, d)).select("symbol", "datetime", F.col("_idx").cast("long").alias("idx"))
