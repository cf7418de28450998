"""Label search, importance, out-of-fold and calibration queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import price
from ..operators import inference, labels, models, runner, search, splits, stationary, stats
from ..series import Rolling, with_features
from ..sources.bars import LI_BARS_SQL, li_bars
from .labelling import _TB, _bars, predictions
from .registry import query, rounded

_PARTS = """s AS (SELECT symbol, count(*) FILTER (label_h5 = 1) / count(*) AS lg, count(*) FILTER (label_h5 = -1) / count(*) AS sh, count(*) FILTER (label_h5 = 0) / count(*) AS ne, avg(bars_to_hit_h5) FILTER (label_h5 <> 0) AS bars,
  sum(CASE label_h5 WHEN 1 THEN mfe_h5 WHEN -1 THEN abs(mae_h5) ELSE 0 END) AS profit, sum(CASE label_h5 WHEN 1 THEN abs(mae_h5) WHEN -1 THEN mfe_h5 ELSE 0 END) AS risk, count(*) FILTER (label_h5 IN (1, -1)) AS trades, avg(atr_14) AS atr FROM l GROUP BY symbol)"""


@query("label_shares", f"{_TB}, {_PARTS} SELECT symbol, round(lg, 6) AS long, round(sh, 6) AS short, round(ne, 6) AS neutral, round(bars, 6) AS bars, round(profit, 4) AS profit, round(risk, 4) AS risk, trades, round(atr, 4) AS atr FROM s")
def label_shares(spark, d):
    s = search.shares(labels.triple_barrier(_bars(spark, d), 5, 1.0, 1.0, 15), 5)
    return s.select("symbol", *[F.round(c, 6).alias(c) for c in ("long", "short", "neutral", "bars")], *[F.round(c, 4).alias(c) for c in ("profit", "risk")], "trades", F.round("atr", 4).alias("atr"))


@query("label_search")
def label_search(spark, d):
    return rounded(search.best(search.search(_bars(spark, d), 5, trials=100, train=0.7)))


@query("label_search_adaptive")
def label_search_adaptive(spark, d):
    return rounded(search.best(search.adaptive(_bars(spark, d), 5, trials=100, train=0.7)))


@query("search_convergence")
def search_convergence(spark, d):
    return rounded(search.convergence(search.adaptive(_bars(spark, d), 5, trials=60, train=0.7)))


def _labelled(spark, d):
    r = Rolling.of_blocks()
    f = with_features(li_bars(spark, d), price.returns(r, (1, 5, 10)) | price.stochastic(r) | price.roc(r), 25).na.drop("any")
    return labels.directional(f, 5, 0.01).where("label_h5 <> -99").withColumn("y", (F.col("label_h5") + 1).cast("double"))


_X = ["return_1", "return_5", "return_10", "stoch_k", "stoch_d", "roc_5"]


@query("feature_importance")
def feature_importance(spark, d):
    return rounded(models.importance(_labelled(spark, d), _X, "y", trees=50))


@query("permutation_importance")
def permutation_importance(spark, d):
    return rounded(models.permutation_importance(_labelled(spark, d), _X, "y"))


@query("feature_frequency")
def feature_frequency(spark, d):
    x = _labelled(spark, d)
    return rounded(models.chosen_often(x, splits.purged_kfold(x, 3, 60, 30), _X, "y", 3, method="hybrid"))


@query("out_of_fold")
def out_of_fold(spark, d):
    x = _labelled(spark, d)
    return rounded(models.out_of_fold(x, splits.purged_kfold(x, 3, 60, 30), _X, "y"))


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    x = models.calibrated(predictions(spark, d), "y", ["m0_p0", "m0_p1", "m0_p2"])
    return rounded(stats.reliability(x, "y", ["m0_p0", "m0_p1", "m0_p2"]))


@query("stationarity")
def stationarity(spark, d):
    r = Rolling.of_blocks()
    return rounded(stationary.dickey_fuller(with_features(li_bars(spark, d), price.returns(r, (1,)), 2), ["return_1", "close"]))


def _margins(x):
    """A fixed model: softmax of the range and the body of a bar; it refuses batches with a wide range."""
    c = x["close"].to_numpy()
    body, wide = np.tanh((c - x["open"].to_numpy()) / c), (x["high"].to_numpy() - x["low"].to_numpy()) / c
    z = np.column_stack([-body, np.log(wide + 1) / 4, body])
    if (wide > 250).any():
        raise ValueError("a range is too wide")
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@query("batch_predictions", f"""WITH {LI_BARS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, tanh((close - open) / close) AS z, (high - low) / close AS y, ln((high - low) / close + 1) / 4 AS w FROM b),
k AS (SELECT *, row_id // 50 AS batch, max(y) OVER (PARTITION BY row_id // 50) AS widest FROM n),
e AS (SELECT *, exp(-z) AS e0, exp(w) AS e1, exp(z) AS e2 FROM k WHERE widest <= 250)
SELECT row_id, batch, symbol, datetime, (CASE WHEN -z >= w AND -z >= z THEN -1 WHEN w >= z THEN 0 ELSE 1 END)::INTEGER AS prediction, round(e0 / (e0 + e1 + e2), 6) AS prob_short, round(e1 / (e0 + e1 + e2), 6) AS prob_neutral, round(e2 / (e0 + e1 + e2), 6) AS prob_long,
  round(greatest(e0, e1, e2) / (e0 + e1 + e2), 6) AS confidence FROM e""")  # fmt: skip
def batch_predictions(spark, d):
    out = inference.predict_batches(li_bars(spark, d), _margins, ["open", "high", "low", "close"], 50, "skip", keep=("symbol", "datetime"))
    return rounded(out.predictions)


_CV = ["body", "range", "volume"]


def _quarters(spark, d):
    """Bars with three columns and a label, and three folds: train on the first quarters, test on the next."""
    c = F.col
    x = li_bars(spark, d).select("symbol", "datetime", ((c("close") - c("open")) / c("open")).alias("body"), ((c("high") - c("low")) / c("close")).alias("range"), "volume", (c("high") > 2 * c("open")).cast("double").alias("y"))
    n = x.count()
    p = splits.positions(x).select("row_id")
    parts = [p.where(F.col("row_id") < n * (f + 1) // 4).withColumns({"fold": F.lit(f), "role": F.when(F.col("row_id") < n * f // 4, "train").otherwise("test")}) for f in (1, 2, 3)]
    return x, parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fold_picks", f"""WITH {LI_BARS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY datetime, symbol) - 1 AS row_id, count(*) OVER () AS size FROM b),
f AS (SELECT fold, (high > 2 * open)::INTEGER AS y, unnest(['body', 'range', 'volume']) AS name, unnest([(close - open) / open, (high - low) / close, volume]) AS x FROM n, (VALUES (1), (2), (3)) v(fold) WHERE row_id < size * fold // 4),
q AS (SELECT fold, name, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM f GROUP BY ALL),
c AS (SELECT fold, name, len(list_filter(e, lambda v: v < x)) AS bin, y, count(*) AS k FROM f JOIN q USING (fold, name) GROUP BY ALL),
w AS (SELECT *, sum(k) OVER (PARTITION BY fold, name) AS t, sum(k) OVER (PARTITION BY fold, name, bin) AS r, sum(k) OVER (PARTITION BY fold, name, y) AS s FROM c),
i AS (SELECT fold, name, sum(k / t * ln(k * t / (r * s))) AS information FROM w GROUP BY ALL)
SELECT fold, name, rank, round(information, 6) AS information FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY information DESC, name)::INTEGER AS rank FROM i) WHERE rank <= 2""")  # fmt: skip
def fold_picks(spark, d):
    x, folds = _quarters(spark, d)
    return rounded(runner.picked(runner.fold_information(x, folds, _CV, "y"), 2))


@query("cross_validation")
def cross_validation(spark, d):
    x, folds = _quarters(spark, d)
    return rounded(runner.tuning_score(runner.cross_validated(x, folds, _CV, "y", 2, classes=2)))
