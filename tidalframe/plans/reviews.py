"""Queries of the checks before training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups
from ..operators import clean, labels, review, splits
from ..series import Rolling, with_features
from ..sources.bars import LI_BARS_SQL, ev_bars, li_bars
from .labelling import _CHRONO, _MS, _SEQ, PREDICTIONS_SQL, _chrono, predictions
from .lookups import _HORIZONS as HORIZONS
from .lookups import BARRIERS_SQL, _values, even, keyed
from .evaluation import _halves, _psi_sql
from .registry import ORACLES, query, rounded
from .scans import _ADX, _J

_W = "PARTITION BY symbol ORDER BY datetime"
_THREE = ["open", "close", "volume"]
_LAB = "CAST(day(datetime) % 3 - 1 AS INTEGER)"


def _labelled(df):
    return df.withColumn("label", (F.day("datetime") % 3 - 1).cast("int"))


@query("roll_moves", f"WITH {LI_BARS_SQL}, m AS (SELECT symbol, datetime, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS change FROM b) SELECT symbol, datetime, round(change, 6) AS change FROM m WHERE abs(change) > 0.1")
def roll_moves(spark, d):
    return rounded(review.roll_moves(li_bars(spark, d)))


@query("outlier_counts", f"""WITH {LI_BARS_SQL}, s AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS sd, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM b GROUP BY symbol),
o AS (SELECT symbol, coalesce(abs(close - m) / nullif(sd, 0) > 5, false) AS z, close < q1 - 3 * (q3 - q1) OR close > q3 + 3 * (q3 - q1) AS i FROM b JOIN s USING (symbol))
SELECT symbol, count(*) AS rows, count_if(z)::BIGINT AS zscore, count_if(i)::BIGINT AS iqr, count_if(z OR i)::BIGINT AS either FROM o GROUP BY symbol""")  # fmt: skip
def outlier_counts(spark, d):
    return review.outlier_counts(li_bars(spark, d))


@query("gap_interpolate", f"""WITH {LI_BARS_SQL}, x AS (SELECT symbol, datetime, row_number() OVER ({_W}) AS i, CASE WHEN day(datetime) % 6 = 0 THEN close END AS close FROM b),
y AS (SELECT *, CASE WHEN close IS NOT NULL THEN i END AS k FROM x),
z AS (SELECT *, max(k) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kp, min(k) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kn FROM y)
SELECT z.symbol, z.datetime, round(CASE WHEN z.close IS NOT NULL THEN z.close WHEN z.i - z.kp <= 2 THEN p.close + (n.close - p.close) * (z.i - z.kp) / (z.kn - z.kp) END, 6) AS close
FROM z LEFT JOIN x p ON p.symbol = z.symbol AND p.i = z.kp LEFT JOIN x n ON n.symbol = z.symbol AND n.i = z.kn""")  # fmt: skip
def gap_interpolate(spark, d):
    b = li_bars(spark, d).withColumn("close", F.when(F.day("datetime") % 6 == 0, F.col("close")))
    return rounded(clean.interpolate(b, "close", 2).select("symbol", "datetime", "close"))


@query("invalid_labels", f"WITH {LI_BARS_SQL}, x AS (SELECT CAST(CASE WHEN day(datetime) % 5 = 4 THEN -99 WHEN day(datetime) % 5 = 3 THEN NULL ELSE day(datetime) % 5 - 1 END AS INTEGER) AS label FROM b) SELECT label, count(*) AS n FROM x WHERE label IS NULL OR label NOT IN (-1, 0, 1) GROUP BY label")
def invalid_labels(spark, d):
    k = F.day("datetime") % 5
    return review.invalid_labels(li_bars(spark, d).withColumn("l", F.when(k == 4, -99).when(k == 3, None).otherwise(k - 1).cast("int")), "l")


@query("label_classes", f"WITH {LI_BARS_SQL} SELECT symbol, datetime, {_LAB} AS label, {_LAB} + 1 AS class, {_LAB} AS back FROM b")
def label_classes(spark, d):
    b = _labelled(li_bars(spark, d)).withColumn("class", review.class_of(F.col("label")))
    return b.select("symbol", "datetime", "label", "class", review.label_of(F.col("class")).alias("back"))


_MULTIPLES = sorted({x for row in (*lookups.BARRIERS, *lookups.BARRIERS_DEFAULT) for x in row[-3:-1]} | {h * 1.5 / 20 + 1.0 for h in HORIZONS})
_SCALED = _values([(name, k, even(k * m, 2)) for name, m in review.PRESETS for k in _MULTIPLES])


@query("preset_barriers", f"""{BARRIERS_SQL}, p AS (SELECT preset, k::DOUBLE AS k, x::DOUBLE AS x FROM {_SCALED} t(preset, k, x))
SELECT symbol, datetime, horizon, max_bars, u.preset, u.x AS k_up, d.x AS k_down FROM r JOIN p u ON abs(u.k - k_up) < 1e-9 JOIN p d ON abs(d.k - k_down) < 1e-9 AND d.preset = u.preset""")  # fmt: skip
def preset_barriers(spark, d):
    k = lookups.barriers(keyed(li_bars(spark, d)).select("symbol", "datetime", "horizon"))
    parts = [review.preset_barriers(k, name).withColumn("preset", F.lit(name)) for name, _ in review.PRESETS]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_FRAMES = (("1min", 1, "5min", 5), ("5min", 5, "15min", 15), ("5min", 5, "4h", 240), ("1h", 60, "1d", 1440))
_BUCKETS = lambda m: f"(SELECT count(*) FROM (SELECT DISTINCT event_type, time_bucket(INTERVAL {m} MINUTE, ts, TIMESTAMP '1970-01-01') FROM events WHERE value > 0))"


@query("resampling_info", " UNION ALL ".join(f"SELECT '{s}' AS source, '{t}' AS target, {a}::INTEGER AS source_minutes, {b}::INTEGER AS target_minutes, {b // a}::INTEGER AS bars_per_target, {b / a}::DOUBLE AS scale_factor, {_BUCKETS(a)} AS source_bars, {_BUCKETS(b)} AS target_bars, round({_BUCKETS(a)} / ({_BUCKETS(b)} * {b // a}), 6) AS fill" for s, a, t, b in _FRAMES))
def resampling_info(spark, d):
    """What resampling should give, and how full the bars of the events are."""
    out = None
    for source, _, target, _ in _FRAMES:
        i = review.resampling_info(source, target)
        n = [ev_bars(spark, d, i[f"{k}_minutes"]).agg(F.count(F.lit(1)).alias(f"{k}_bars")) for k in ("source", "target")]
        one = n[0].crossJoin(F.broadcast(n[1]))  # a row each
        fill = F.round(F.col("source_bars") / (F.col("target_bars") * i["bars_per_target"]), 6)
        one = one.select(*[F.lit(v).alias(k) for k, v in i.items()], "source_bars", "target_bars", fill.alias("fill"))
        out = one if out is None else out.unionByName(one)
    return out


@query("meta_metrics", f"""WITH m AS ({ORACLES["meta_label"]}) SELECT symbol, count(*) AS total, count_if(meta_label_h5 <> -99)::BIGINT AS valid, count_if(meta_label_h5 = 1)::BIGINT AS right, count_if(meta_label_h5 = 0)::BIGINT AS wrong,
  round(count_if(meta_label_h5 = 1) / nullif(count_if(meta_label_h5 <> -99), 0), 6) AS accuracy, round(avg(abs(margin_h5)) FILTER (meta_label_h5 = 1), 5) AS right_margin, round(avg(abs(margin_h5)) FILTER (meta_label_h5 = 0), 5) AS wrong_margin,
  round(avg(abs(margin_h5)) FILTER (meta_label_h5 = 1) / nullif(avg(abs(margin_h5)) FILTER (meta_label_h5 = 0), 0), 4) AS margin_ratio FROM m GROUP BY symbol""".replace("round(CASE WHEN sg <> 0 THEN (q - 1) * sg END, 6) AS margin_h5", "CASE WHEN sg <> 0 THEN (q - 1) * sg END AS margin_h5"))  # fmt: skip
def meta_metrics(spark, d):
    k = F.day("datetime") % 3
    b = li_bars(spark, d).withColumn("sg", F.when(k == 0, 0).when(k == 1, 1).otherwise(-1))
    m = review.meta_metrics(labels.meta(b, 5, "sg"), 5)
    return m.withColumns({"accuracy": F.round("accuracy", 6), "right_margin": F.round("right_margin", 5), "wrong_margin": F.round("wrong_margin", 5), "margin_ratio": F.round("margin_ratio", 4)})


@query("split_overlaps", f"{_CHRONO}, k AS (SELECT row_id, split FROM s WHERE split IS NOT NULL) SELECT a, b, (SELECT count(*) FROM k x JOIN k y USING (row_id) WHERE x.split = a AND y.split = b) AS n FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) t(a, b)")
def split_overlaps(spark, d):
    return review.overlaps(_chrono(spark, d))


@query("split_share_check", f"{_CHRONO}, n AS (SELECT split, symbol, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split) AS pct FROM s WHERE split IS NOT NULL GROUP BY split, symbol) SELECT split, symbol, n, round(pct, 6) AS pct, pct >= 20 AS ok FROM n")
def split_share_check(spark, d):
    return rounded(review.share_check(_chrono(spark, d)))


@query("sequence_coverage", f"{_SEQ}, n AS (SELECT symbol, count(*) AS rows, count_if(len(xs) = 8 AND broken = 0)::BIGINT AS sequences FROM q GROUP BY symbol) SELECT symbol, rows, sequences, round(sequences / rows, 6) AS share FROM n")
def sequence_coverage(spark, d):
    b = li_bars(spark, d)
    return rounded(review.sequence_coverage(b, splits.sequences(b, ["close"], 8)))


def _split(spark, d):
    return _chrono(spark, d).drop("close").join(li_bars(spark, d), ["symbol", "datetime"])


_TR = ", ".join(f"avg({c}) FILTER (split = 'train') AS m_{c}, stddev_pop({c}) FILTER (split = 'train') AS s_{c}" for c in _THREE)
_ZS = ", ".join(f"greatest(least(({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END), 5), -5) AS {c}" for c in _THREE)
_SCALED = f"{_CHRONO}, k AS (SELECT s.split, b.* FROM s JOIN b USING (symbol, datetime) WHERE split IS NOT NULL), f AS (SELECT {_TR} FROM k), z AS (SELECT split, symbol, datetime, {_ZS} FROM k, f)"


@query("scale_splits", f"{_SCALED} SELECT split, symbol, datetime, {', '.join(f'round({c}, 6) AS {c}' for c in _THREE)} FROM z")
def scale_splits(spark, d):
    return rounded(review.scale_splits(_split(spark, d), _THREE, "standard").select("split", "symbol", "datetime", *_THREE))


@query("scaling_report", f"""{_SCALED}, x AS ({" UNION ALL ".join(f"SELECT split, '{c}' AS name, {c} AS x FROM z" for c in _THREE)}), g AS (SELECT split, name, count(x) AS n, count_if(x IS NULL)::BIGINT AS missing, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY ALL)
SELECT g.split, g.name, g.n, g.missing, round(g.mean, 6) AS mean, round(g.std, 6) AS std, round(abs(g.mean - t.mean) / nullif(t.std, 0), 6) AS shift, coalesce(abs(g.mean - t.mean) / nullif(t.std, 0) > 5, false) AS drifted FROM g JOIN g t ON t.name = g.name AND t.split = 'train'""")  # fmt: skip
def scaling_report(spark, d):
    return rounded(review.scaling_report(review.scale_splits(_split(spark, d), _THREE, "standard"), _THREE))


@query("model_ready", f"""{_SCALED} SELECT split, count(*) AS rows, {" + ".join(f"count_if({c} IS NULL)" for c in _THREE)} ::BIGINT AS missing, ({" + ".join(f"count_if(abs({c}) > 5)" for c in _THREE)})::BIGINT AS out_of_range, ({" + ".join(f"CAST(min({c}) = max({c}) AS INTEGER)" for c in _THREE)})::INTEGER AS constant,
  count_if({_LAB} NOT IN (-1, 0, 1))::BIGINT AS invalid_labels, round(least({", ".join(f"count_if({_LAB} = {v})" for v in (-1, 0, 1))}) * 100.0 / count(*), 6) AS rarest_pct, {" + ".join(f"CAST(min({c}) = max({c}) AS INTEGER)" for c in _THREE)} = 0 AND least({", ".join(f"count_if({_LAB} = {v})" for v in (-1, 0, 1))}) * 100.0 / count(*) >= 5 AS ready FROM z GROUP BY split""")  # fmt: skip
def model_ready(spark, d):
    return rounded(review.model_ready(_labelled(review.scale_splits(_split(spark, d), _THREE, "standard")), _THREE, "label"))


@query("fold_scaling", f"""WITH {LI_BARS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, count(*) OVER () AS n FROM b), f AS (SELECT unnest(range(4))::INTEGER AS fold),
r AS (SELECT row_id, fold, CASE WHEN row_id >= fold * (n // 4) AND (fold = 3 OR row_id < (fold + 1) * (n // 4)) THEN 'test' WHEN row_id < fold * (n // 4) - 60 OR fold < 3 AND row_id >= (fold + 1) * (n // 4) + 100 THEN 'train' END AS role, close, volume FROM p, f),
m AS (SELECT fold, avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM r WHERE role = 'train' GROUP BY fold)
SELECT row_id, fold, role, round(greatest(least((close - mc) / (CASE WHEN sc > 0 THEN sc ELSE 1 END), 5), -5), 6) AS close, round(greatest(least((volume - mv) / (CASE WHEN sv > 0 THEN sv ELSE 1 END), 5), -5), 6) AS volume FROM r JOIN m USING (fold) WHERE role IS NOT NULL""")  # fmt: skip
def fold_scaling(spark, d):
    b = li_bars(spark, d)
    folds = splits.purged_kfold(b, 4, 60, 100)
    out = review.scale_fold(splits.positions(b), folds, ["close", "volume"])
    return rounded(out.withColumn("row_id", F.col("row_id").cast("long")))


_HOLES = f"SELECT row_id, y, m0_p0, CASE WHEN row_id % 7 <> 0 THEN m1_p0 END AS m1_p0, CASE WHEN row_id % 11 <> 0 THEN m2_p0 END AS m2_p0 FROM ({PREDICTIONS_SQL})"


def _holes(spark, d):
    return predictions(spark, d).select("row_id", "y", "m0_p0", F.when(F.col("row_id") % 7 != 0, F.col("m1_p0")).alias("m1_p0"), F.when(F.col("row_id") % 11 != 0, F.col("m2_p0")).alias("m2_p0"))


@query("valid_predictions", f"SELECT row_id, y, round(m0_p0, 6) AS m0_p0, round(m1_p0, 6) AS m1_p0, round(m2_p0, 6) AS m2_p0 FROM ({_HOLES}) WHERE m1_p0 IS NOT NULL AND m2_p0 IS NOT NULL")
def valid_predictions(spark, d):
    x = _holes(spark, d)
    frames = {m: x.select("row_id", F.col(f"{m}_p0").alias("p0")) for m in _MS}
    return rounded(review.merged_predictions(frames, x.select("row_id", "y")))


@query("prediction_coverage", f"WITH x AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS rows, count_if({m}_p0 IS NULL)::BIGINT AS missing, round(1 - count_if({m}_p0 IS NULL) / count(*), 6) AS coverage FROM x" for m in _MS))
def prediction_coverage(spark, d):
    return rounded(review.prediction_coverage(_holes(spark, d), list(_MS)))


@query("prediction_correlations", f"WITH x AS ({PREDICTIONS_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}_p0, {b}_p0), 6) AS corr, corr({a}_p0, {b}_p0) < 0.7 AS diverse FROM x" for a, b in (("m0", "m1"), ("m0", "m2"), ("m1", "m2"))))
def prediction_correlations(spark, d):
    return rounded(review.prediction_correlations(predictions(spark, d), list(_MS)))


@query("label_sanity", f"WITH {LI_BARS_SQL}, y AS (SELECT CAST(CASE WHEN day(datetime) % 9 = 0 THEN -1 WHEN day(datetime) % 9 = 1 THEN 1 WHEN day(datetime) % 9 = 2 THEN -99 ELSE 0 END AS INTEGER) AS label FROM b), n AS (SELECT label, count(*) AS n FROM y WHERE label <> -99 GROUP BY label) SELECT label, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct, CASE WHEN n * 100.0 / sum(n) OVER () < 20 THEN 'rare' WHEN n * 100.0 / sum(n) OVER () > 60 THEN 'dominant' ELSE 'none' END AS warning FROM n")
def label_sanity(spark, d):
    k = F.day("datetime") % 9
    return rounded(review.label_sanity(li_bars(spark, d).withColumn("l", F.when(k == 0, -1).when(k == 1, 1).when(k == 2, -99).otherwise(0)), "l"))


@query("selected_features", f"""WITH {LI_BARS_SQL}, c AS (SELECT corr(close, high) AS ch, corr(close, volume) AS cv, corr(high, volume) AS hv FROM b)
SELECT 'close' AS name, 'kept' AS fate UNION ALL SELECT 'flat', 'low_variance' UNION ALL SELECT 'high', CASE WHEN abs(ch) >= 0.85 OR abs(cv) >= 0.85 AND abs(hv) >= 0.85 THEN 'correlated' ELSE 'kept' END FROM c
UNION ALL SELECT 'volume', CASE WHEN abs(cv) >= 0.85 OR abs(hv) >= 0.85 THEN 'correlated' ELSE 'kept' END FROM c""")  # fmt: skip
def selected_features(spark, d):
    b = li_bars(spark, d).withColumn("flat", F.lit(1.0) + F.col("close") * 0)
    return review.selected_features(b, ["close", "flat", "high", "volume"])


@query("drift_monitor", f"WITH p AS ({ORACLES['psi_quantile']}), k AS ({ORACLES['ks_stat']}) SELECT 'psi' AS method, name, psi AS value, psi > 0.2 AS drifted FROM p UNION ALL SELECT 'ks', name, statistic, statistic > 0.1 FROM k")
def drift_monitor(spark, d):
    e, a = _halves(spark, d)
    psi, ks = review.drift(e, a, _THREE), review.drift(e, a, _THREE, "ks", 0.1)
    return rounded(psi.withColumn("method", F.lit("psi")).unionByName(ks.withColumn("method", F.lit("ks"))).select("method", "name", "value", "drifted"))


@query("drift_summary", f"WITH p AS ({ORACLES['psi_quantile']}) SELECT count(*) AS n_columns, count_if(psi > 0.2)::BIGINT AS n_drifted, round(count_if(psi > 0.2) / count(*), 6) AS share, max(psi) AS worst FROM p")
def drift_summary(spark, d):
    return rounded(review.drift_summary(review.drift(*_halves(spark, d), _THREE)))


def _between(part: str) -> str:
    e = _psi_sql(f"SELECT name, list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS g FROM e GROUP BY name", 1e-6, True)
    body = e[e.index(", g AS (") :]
    x = " UNION ALL ".join(f"SELECT split, '{c}' AS name, {c} AS x FROM z0" for c in _THREE)
    head = _SCALED.replace("z AS (SELECT split", "z0 AS (SELECT split").replace(", k AS (SELECT s.split", ", k0 AS (SELECT s.split").replace("FROM k", "FROM k0")
    return f"SELECT '{part}' AS split, name, psi AS value, psi > 0.2 AS drifted FROM ({head}, x0 AS ({x}), e AS (SELECT name, x FROM x0 WHERE split = 'train'), a AS (SELECT name, x FROM x0 WHERE split = '{part}'){body})"


@query("split_drift", f"{_between('val')} UNION ALL {_between('test')}")
def split_drift(spark, d):
    return rounded(review.split_drift(review.scale_splits(_split(spark, d), _THREE, "standard"), _THREE).select("split", "name", "value", "drifted"))


@query("lookahead_audit", f"""WITH {LI_BARS_SQL}, x AS (SELECT symbol, count(*) AS n FROM b WHERE datetime < TIMESTAMP '1996-01-01' GROUP BY symbol)
SELECT 'sma_10' AS name, sum(n)::BIGINT AS n, 0::BIGINT AS changed FROM x UNION ALL SELECT 'leak', sum(n)::BIGINT, (SELECT count(*) FROM (SELECT datetime, lead(close) OVER ({_W}) AS nx, lead(datetime) OVER ({_W}) AS nd FROM b) WHERE datetime < TIMESTAMP '1996-01-01' AND nd >= TIMESTAMP '1996-01-01' AND nx IS NOT NULL) FROM x""")  # fmt: skip
def lookahead_audit(spark, d):
    def make(df):
        r = Rolling.of_blocks()
        return with_features(df, {"sma_10": r.mean(r.lag(r.c), 10), "leak": r.lead(r.c)}, 11, 1)

    return review.lookahead_audit(li_bars(spark, d), make, ["sma_10", "leak"], "1996-01-01")


@query("trend_by_strength", f"{_ADX}, x AS (SELECT i.symbol, i.datetime, i.close, ax.y AS adx, CASE WHEN count(i.close) OVER w = 50 THEN avg(i.close) OVER w END AS m FROM i {_J.format('ax')} WINDOW w AS (PARTITION BY i.symbol ORDER BY i.datetime ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT symbol, datetime, CASE WHEN adx IS NULL OR m IS NULL THEN NULL WHEN adx > 25 AND close > m THEN 'uptrend' WHEN adx > 25 AND close < m THEN 'downtrend' ELSE 'sideways' END AS trend FROM x")
def trend_by_strength(spark, d):
    return review.trend_by_strength(li_bars(spark, d)).select("symbol", "datetime", "trend")
