"""Scaling, drift, calibration, vote and evaluation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import stats
from ..quantiles import quantiles
from ..sources.bars import LI_BARS_SQL, li_bars
from .labelling import PREDICTIONS_SQL, predictions
from .registry import query, rounded

_COLS = ["open", "high", "low", "close", "volume"]
_LONG = "x AS (SELECT datetime, 'open' AS name, open AS x FROM b UNION ALL SELECT datetime, 'close', close FROM b UNION ALL SELECT datetime, 'volume', volume FROM b)"
_THREE = ["open", "close", "volume"]
_Q = "quantile_cont"


@query("robust_scaler", f"""WITH {LI_BARS_SQL}, {_LONG}, p AS (SELECT name, {_Q}(x, 0.5) AS fill, min(x) AS lo FROM x GROUP BY name), s AS (SELECT name, fill, CASE WHEN name = 'volume' THEN CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END END AS shift FROM p),
y AS (SELECT name, fill, shift, CASE WHEN shift IS NULL THEN x ELSE ln(1 + x + shift) END AS y FROM x JOIN s USING (name))
SELECT name, round(fill, 6) AS fill, round(shift, 6) AS shift, round({_Q}(y, 0.5), 6) AS center, round({_Q}(y, 0.75) - {_Q}(y, 0.25), 6) AS scale FROM y GROUP BY name, fill, shift""")  # fmt: skip
def robust_scaler(spark, d):
    return rounded(stats.fit_scaler(li_bars(spark, d), _THREE, "robust", ("volume",)))


def _scaled(kind: str, center: str, scale: str) -> str:
    parts = ", ".join(f"(SELECT {center.replace('$', c)} FROM b) AS m_{c}, (SELECT {scale.replace('$', c)} FROM b) AS s_{c}" for c in _THREE)
    return f"WITH {LI_BARS_SQL}, p AS (SELECT {parts}) SELECT symbol, datetime, {', '.join(f'round(greatest(least(({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END), 5), -5), 6) AS {c}' for c in _THREE)} FROM b, p"


for _kind, _c, _s in (("robust", f"{_Q}($, 0.5)", f"{_Q}($, 0.75) - {_Q}($, 0.25)"), ("standard", "avg($)", "stddev_pop($)"), ("minmax", "min($)", "max($) - min($)")):

    @query(f"{_kind}_scale", _scaled(_kind, _c, _s))
    def _scale(spark, d, kind=_kind):
        b = li_bars(spark, d)
        return rounded(stats.transform(b, stats.fit_scaler(b, _THREE, kind)).select("symbol", "datetime", *_THREE))


@query("scale_round_trip", f"WITH {LI_BARS_SQL} SELECT symbol, datetime, true AS close_same, true AS volume_same FROM b")
def scale_round_trip(spark, d):
    b = li_bars(spark, d)
    s = stats.fit_scaler(b, ["close", "volume"], "standard", ("volume",))
    back = stats.inverse(stats.transform(b.withColumns({"c0": F.col("close"), "v0": F.col("volume")}), s, clip=1e9), s)
    return back.select("symbol", "datetime", (F.abs(F.col("close") - F.col("c0")) < 1e-6).alias("close_same"), (F.abs(F.col("volume") - F.col("v0")) < 1e-6).alias("volume_same"))


@query("low_variance", f"""WITH {LI_BARS_SQL}, x AS (SELECT 'close' AS name, close AS x FROM b UNION ALL SELECT 'flat', 1.0 + close * 0 FROM b UNION ALL SELECT 'volume', volume FROM b), s AS (SELECT name, var_samp(x) AS v, avg(x) AS m, count(x) AS n FROM x GROUP BY name)
SELECT name, round(v, 4) AS variance, round(v / nullif(m * m, 0), 6) AS relative, n >= 100 AND v < 0.0001 AND coalesce(v / nullif(m * m, 0), 0) < 0.0001 AS drop FROM s""")  # fmt: skip
def low_variance(spark, d):
    b = li_bars(spark, d).withColumn("flat", F.lit(1.0) + F.col("close") * 0)
    out = stats.low_variance(b, ["close", "flat", "volume"])
    return out.select("name", F.round("variance", 4).alias("variance"), F.round("relative", 6).alias("relative"), "drop")


@query("corr_pairs", f"WITH {LI_BARS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{z}' AS b, round(corr({a}, {z}), 6) AS corr FROM b" for a, z in combinations(sorted(_COLS), 2)))
def corr_pairs(spark, d):
    return rounded(stats.correlations(li_bars(spark, d), _COLS))


@query("normalisation_stats", f"""WITH {LI_BARS_SQL}, {_LONG}, s AS (SELECT name, avg(x) AS m, stddev_samp(x) AS sd FROM x GROUP BY name)
SELECT name, round(any_value(m), 6) AS mean, round(any_value(sd), 6) AS std, {", ".join(f"round({_Q}(x, {p}), 6) AS {k}" for k, p in (("p1", 0.01), ("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))}, round(skewness(x) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew, round(kurtosis_pop(x), 6) AS kurtosis,
  {", ".join(f"count(*) FILTER (abs((x - m) / nullif(sd, 0)) > {k}) AS z_over_{k}" for k in (3, 5, 10))} FROM x JOIN s USING (name) GROUP BY name""")  # fmt: skip
def normalisation_stats(spark, d):
    return rounded(stats.normalisation_stats(li_bars(spark, d), _THREE))


@query("integrity", f"WITH {LI_BARS_SQL} SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT datetime) AS duplicates, 0::BIGINT AS missing, 0::BIGINT AS infinite, min(datetime) AS first_time, max(datetime) AS last_time FROM b GROUP BY symbol")
def integrity(spark, d):
    return stats.integrity(li_bars(spark, d), "symbol", "datetime", _THREE)


def _halves(spark, d):
    b = li_bars(spark, d)
    return b.where("datetime < TIMESTAMP_NTZ '1995-06-01'"), b.where("datetime >= TIMESTAMP_NTZ '1995-06-01'")


_E = f"WITH {LI_BARS_SQL}, {_LONG}, e AS (SELECT name, x FROM x WHERE datetime < TIMESTAMP '1995-06-01'), a AS (SELECT name, x FROM x WHERE datetime >= TIMESTAMP '1995-06-01')"


def _psi_sql(edges: str, eps: float, clip: bool) -> str:
    inside = "x >= g[1] AND x <= g[len(g)]"
    share = lambda t: f"greatest(coalesce(n{t} / nullif(t{t}, 0), 0), {eps!r})" if clip else f"coalesce(n{t} / nullif(t{t}, 0), 0) + {eps!r}"
    where = f"WHERE {inside}" if clip else ""
    return f"""{_E}, g AS ({edges}), z AS (SELECT name, g, x, 0 AS w FROM e JOIN g USING (name) UNION ALL SELECT name, g, x, 1 FROM a JOIN g USING (name)),
c AS (SELECT name, CASE WHEN {inside} THEN least(len(list_filter(g, lambda v: v <= x)), len(g) - 1) END AS bin, count(*) FILTER (w = 0) AS n0, count(*) FILTER (w = 1) AS n1 FROM z {where} GROUP BY 1, 2),
t AS (SELECT name, sum(n0) AS t0, sum(n1) AS t1 FROM c GROUP BY name), k AS (SELECT name, unnest(range(1, len(g))) AS bin FROM g),
q AS (SELECT k.name, {share(0)} AS p, {share(1)} AS q FROM k LEFT JOIN c USING (name, bin) JOIN t ON t.name = k.name)
SELECT name, round(sum((q - p) * ln(q / p)), 6) AS psi FROM q GROUP BY name"""


@query("psi_quantile", _psi_sql(f"SELECT name, list_sort(list_distinct({_Q}(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS g FROM e GROUP BY name", 1e-6, True))
def psi_quantile(spark, d):
    return rounded(stats.psi_quantile(*_halves(spark, d), _THREE))


@query("psi_width", _psi_sql("SELECT name, list_transform(range(0, 11), lambda i: CASE WHEN i = 10 THEN hi ELSE lo + (hi - lo) / 10 * i END) AS g FROM (SELECT name, min(x) AS lo, max(x) AS hi FROM e GROUP BY name)", 1e-10, False))
def psi_width(spark, d):
    return rounded(stats.psi_width(*_halves(spark, d), _THREE))


@query("ks_stat", f"""{_E}, v AS (SELECT name, x, sum(i) AS n0, sum(j) AS n1 FROM (SELECT name, x, 1 AS i, 0 AS j FROM e UNION ALL SELECT name, x, 0, 1 FROM a) GROUP BY ALL),
c AS (SELECT name, sum(n0) OVER (PARTITION BY name ORDER BY x) / sum(n0) OVER (PARTITION BY name) AS f, sum(n1) OVER (PARTITION BY name ORDER BY x) / sum(n1) OVER (PARTITION BY name) AS g FROM v),
n AS (SELECT name, sum(n0)::BIGINT AS n_a, sum(n1)::BIGINT AS n_b FROM v GROUP BY name) SELECT name, round(max(abs(f - g)), 6) AS statistic, any_value(n_a) AS n_a, any_value(n_b) AS n_b FROM c JOIN n USING (name) GROUP BY name""")  # fmt: skip
def ks_stat(spark, d):
    return rounded(stats.ks(*_halves(spark, d), _THREE))


@query("ks_p_values")
def ks_p_values(spark, d):
    k = stats.ks(*_halves(spark, d), _THREE)
    return rounded(k.withColumn("p", stats.ks_p(F.col("statistic"), F.col("n_a"), F.col("n_b"))))


_P0 = ["m0_p0", "m0_p1", "m0_p2"]
_ARG = "(list_position([{0}_p0, {0}_p1, {0}_p2], greatest({0}_p0, {0}_p1, {0}_p2)) - 1)"


def _predicted(spark, d):
    return predictions(spark, d).withColumn("pred", stats.predicted(_P0))


_X = f"WITH x AS ({PREDICTIONS_SQL}), z AS (SELECT *, CAST({_ARG.format('m0')} AS INTEGER) AS pred FROM x)"


@query("confusion", f"{_X} SELECT y AS truth, pred, count(*) AS n FROM z GROUP BY ALL")
def confusion(spark, d):
    return stats.confusion(_predicted(spark, d))


@query("classification_report", f"""{_X}, k AS (SELECT unnest([0, 1, 2]) AS k), m AS (SELECT k, (SELECT count(*) FROM z WHERE y = k) AS support, (SELECT count(*) FROM z WHERE y = k AND pred = k) AS tp, (SELECT count(*) FROM z WHERE pred = k) AS pp FROM k),
r AS (SELECT k, support, tp, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM m), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)
SELECT k::VARCHAR AS name, support::BIGINT AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM f UNION ALL SELECT 'macro', sum(support)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM f UNION ALL
SELECT 'weighted', sum(support)::BIGINT, round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM f UNION ALL SELECT 'accuracy', sum(support)::BIGINT, NULL, NULL, round(sum(tp) / sum(support), 6) FROM f""")  # fmt: skip
def classification_report(spark, d):
    return rounded(stats.classification(_predicted(spark, d)))


_SIG = "SELECT *, y - 1 AS t, pred - 1 AS s, row_id % 5 AS grp FROM z"


def _signals(spark, d):
    return _predicted(spark, d).select("row_id", (F.col("y") - 1).alias("t"), (F.col("pred") - 1).alias("s"), (F.col("row_id") % 5).alias("grp"))


@query("streaks", f"""{_X}, q AS ({_SIG}), w AS (SELECT *, CAST(t = s AS INTEGER) AS win FROM q WHERE s <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY row_id) - row_number() OVER (PARTITION BY grp, win ORDER BY row_id) AS run FROM w), n AS (SELECT grp, win, run, count(*) AS n FROM r GROUP BY ALL)
SELECT grp, coalesce(max(n) FILTER (win = 1), 0) AS max_wins, coalesce(max(n) FILTER (win = 0), 0) AS max_losses FROM n GROUP BY grp""")  # fmt: skip
def streaks(spark, d):
    return stats.streaks(_signals(spark, d), "t", "s", "grp", ["row_id"])


@query("trading_metrics", f"""{_X}, q AS ({_SIG}) SELECT grp, count(*) FILTER (s <> 0) AS signals, count(*) FILTER (s = 1) AS longs, count(*) FILTER (s = -1) AS shorts, round(count(*) FILTER (s <> 0 AND s = t) / nullif(count(*) FILTER (s <> 0), 0), 6) AS win_rate,
  round(count(*) FILTER (s = 1 AND t = 1) / nullif(count(*) FILTER (s = 1), 0), 6) AS long_accuracy, round(count(*) FILTER (s = -1 AND t = -1) / nullif(count(*) FILTER (s = -1), 0), 6) AS short_accuracy,
  round(avg(CASE WHEN s = t THEN 1.0 ELSE -1.0 END) FILTER (s <> 0) / nullif(stddev_pop(CASE WHEN s = t THEN 1.0 ELSE -1.0 END) FILTER (s <> 0), 0), 6) AS sharpe FROM q GROUP BY grp""")  # fmt: skip
def trading_metrics(spark, d):
    return rounded(stats.trading(_signals(spark, d), "t", "s", "grp"))


@query("brier", f"{_X} SELECT round(avg(pow(m0_p0 - (y = 0)::INT, 2) + pow(m0_p1 - (y = 1)::INT, 2) + pow(m0_p2 - (y = 2)::INT, 2)), 6) AS brier FROM z")
def brier(spark, d):
    return rounded(stats.brier(predictions(spark, d), "y", _P0))


_BINS = f"{_X}, q AS (SELECT greatest(m0_p0, m0_p1, m0_p2) AS c, CAST(pred = y AS INTEGER) AS ok FROM z), r AS (SELECT CAST(greatest(ceil(c * 10), 1) AS INTEGER) AS bin, count(*) AS n, avg(c) AS confidence, avg(ok) AS accuracy FROM q GROUP BY 1)"


@query("reliability_bins", f"{_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM r")
def reliability_bins(spark, d):
    return rounded(stats.reliability(predictions(spark, d), "y", _P0))


@query("ece_bins", f"{_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM r")
def ece_bins(spark, d):
    return rounded(stats.ece(predictions(spark, d), "y", _P0))


@query("conformal_lac", f"""{_X}, c AS (SELECT 1 - [m0_p0, m0_p1, m0_p2][y + 1] AS s FROM z WHERE row_id % 2 = 0), q AS (SELECT {_Q}(s, 0.9) AS q FROM c),
u AS (SELECT row_id, pred, list_filter([0, 1, 2], lambda k: 1 - [m0_p0, m0_p1, m0_p2][k + 1] <= q) AS cs FROM z, q WHERE row_id % 2 = 1)
SELECT row_id, array_to_string(CASE WHEN len(cs) > 0 THEN cs ELSE [pred] END, ',') AS classes FROM u""")  # fmt: skip
def conformal_lac(spark, d):
    x = predictions(spark, d)
    calib, rest = x.where("row_id % 2 = 0"), x.where("row_id % 2 = 1")
    q = quantiles(calib.select(stats.conformal_score("y", _P0).alias("s")), [], "s", [0.9]).select(F.col("q")[0].alias("q"))
    return stats.conformal_sets(rest, q, _P0).select("row_id", F.array_join("classes", ",").alias("classes"))


@query("conformal_coverage", f"""{_X}, c AS (SELECT list_sort(list(1 - [m0_p0, m0_p1, m0_p2][y + 1])) AS l, least(1, 0.9 * (1 + 1.0 / count(*))) * (count(*) - 1) AS p FROM z WHERE row_id % 2 = 0),
q AS (SELECT l[floor(p)::INTEGER + 1] + (l[ceil(p)::INTEGER + 1] - l[floor(p)::INTEGER + 1]) * (p - floor(p)) AS q FROM c),
u AS (SELECT y, pred, list_filter([0, 1, 2], lambda k: 1 - [m0_p0, m0_p1, m0_p2][k + 1] <= q) AS cs FROM z, q WHERE row_id % 2 = 1),
s AS (SELECT y, CASE WHEN len(cs) > 0 THEN cs ELSE [pred] END AS cs FROM u)
SELECT round(avg(CAST(list_contains(cs, y) AS INTEGER)), 6) AS coverage, round(avg(len(cs)), 6) AS size FROM s""")  # fmt: skip
def conformal_coverage(spark, d):
    x = predictions(spark, d)
    q = stats.conformal_quantile(x.where("row_id % 2 = 0"), "y", _P0)
    s = stats.conformal_sets(x.where("row_id % 2 = 1"), q, _P0)
    return rounded(s.agg(F.avg(F.array_contains("classes", F.col("y")).cast("double")).alias("coverage"), F.avg(F.size("classes").cast("double")).alias("size")))


_V = ["m0", "m1", "m2"]


@query("soft_vote", f"WITH x AS ({PREDICTIONS_SQL}), v AS (SELECT row_id, {', '.join(f'(m0_p{k} * 2 + m1_p{k} + m2_p{k}) / 4 AS p{k}' for k in range(3))} FROM x) SELECT row_id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM v")
def soft_vote(spark, d):
    return rounded(stats.soft_vote(predictions(spark, d), _V, [2.0, 1.0, 1.0]).select("row_id", "p0", "p1", "p2"), 9)


@query("hard_vote", f"WITH x AS ({PREDICTIONS_SQL}), a AS (SELECT row_id, {', '.join(f'{_ARG.format(m)} AS {m}' for m in _V)} FROM x), c AS (SELECT row_id, {', '.join(f'(m0 = {k})::INT + (m1 = {k})::INT + (m2 = {k})::INT AS n{k}' for k in range(3))} FROM a) SELECT row_id, CAST(list_position([n0, n1, n2], greatest(n0, n1, n2)) - 1 AS INTEGER) AS vote FROM c")
def hard_vote(spark, d):
    return stats.hard_vote(predictions(spark, d), _V).select("row_id", "vote")


@query("softmax", f"WITH x AS ({PREDICTIONS_SQL}), e AS (SELECT row_id, exp(m0_p0) AS a, exp(m0_p1) AS b, exp(m0_p2) AS c FROM x) SELECT row_id, round(a / (a + b + c), 6) AS s0, round(b / (a + b + c), 6) AS s1, round(c / (a + b + c), 6) AS s2 FROM e")
def softmax(spark, d):
    return rounded(predictions(spark, d).withColumn("s", stats.softmax(_P0)).select("row_id", *[F.get("s", F.lit(k)).alias(f"s{k}") for k in range(3)]))


@query("sharpe", f"WITH {LI_BARS_SQL}, f AS (SELECT symbol, lead(close, 1) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 AS r FROM b) SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM f GROUP BY symbol")
def sharpe(spark, d):
    from ..operators.labels import forward_returns

    return rounded(stats.sharpe(forward_returns(li_bars(spark, d), 1), "fwd_return_h1", "symbol"))


@query("cv_stability", f"""WITH x AS ({PREDICTIONS_SQL}), f AS (SELECT row_id % 6 AS fold, avg(m0_p0) AS v FROM x GROUP BY 1), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM f)
SELECT 'm0' AS model, round(m, 6) AS mean, round(sd, 6) AS std, round(sd / m, 6) AS cv, round(lo, 6) AS min, round(hi, 6) AS max, CASE WHEN sd / m < 0.15 THEN 'excellent' WHEN sd / m < 0.25 THEN 'good' WHEN sd / m < 0.4 THEN 'moderate' WHEN sd / m < 0.6 THEN 'poor' ELSE 'unstable' END AS grade FROM s""")  # fmt: skip
def cv_stability(spark, d):
    f = predictions(spark, d).groupBy((F.col("row_id") % 6).alias("fold")).agg(F.avg("m0_p0").alias("v")).withColumn("model", F.lit("m0"))
    return rounded(stats.stability(f, ["model"], "v"))


