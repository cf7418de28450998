"""Columns picked in folds: information against plain counts, and nothing of the test rows in a pick."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import runner, splits


def frame(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1).astype(int)
    return pd.DataFrame({"symbol": "s", "datetime": pd.date_range("2024-01-01", periods=n, freq="min"), "a": x[:, 0], "b": x[:, 1], "c": np.round(x[:, 2]), "y": y.astype(float)})


def information(x, y):
    edges = np.quantile(x, np.arange(1, 10) / 10)
    t = pd.crosstab((edges[None, :] < x.to_numpy()[:, None]).sum(axis=1), y.to_numpy()).to_numpy() / len(x)
    outer = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
    return (t[t > 0] * np.log(t[t > 0] / outer[t > 0])).sum()


def test_information_picks_and_scores(spark):
    p = frame()
    p.loc[7, "a"] = np.nan
    df = spark.createDataFrame(p).withColumn("a", F.nanvl("a", F.lit(None)))
    folds = splits.purged_kfold(df, 2, 5, 5)
    where = {(r.fold, r.role): [] for r in folds.select("fold", "role").distinct().collect()}
    for r in folds.collect():
        where[r.fold, r.role].append(r.row_id)
    got = {(r.fold, r["name"]): r.information for r in runner.fold_information(df, folds, ["a", "b", "c"], "y").collect()}
    for (fold, name), v in got.items():
        q = p.iloc[sorted(where[fold, "train"])].dropna(subset=[name])
        assert v == pytest.approx(information(q[name], q.y), abs=1e-9)
    assert len(got) == 6
    scores = runner.cross_validated(df, folds, ["a", "b", "c"], "y", 2).orderBy("fold").collect()
    assert [r.columns for r in scores] == [["a", "b"], ["a", "b"]] and all(r.accuracy > 0.8 and 0 < r.f1 <= 1 for r in scores)
    # nothing of the test rows is in a pick
    spoilt = p.copy()
    test = sorted(where[scores[0].fold, "test"])
    spoilt.loc[test, "a"], spoilt.loc[test, "c"] = 0.0, spoilt.y[test]
    again = {(r.fold, r["name"]): r.information for r in runner.fold_information(spark.createDataFrame(spoilt).withColumn("a", F.nanvl("a", F.lit(None))), folds, ["a", "b", "c"], "y").where(F.col("fold") == scores[0].fold).collect()}
    assert again == {k: pytest.approx(v) for k, v in got.items() if k[0] == scores[0].fold}
    t = runner.tuning_score(spark.createDataFrame(scores)).first()
    f1 = np.array([r.f1 for r in scores])
    assert t.score == pytest.approx(f1.mean() - 0.1 * f1.std()) and t.stability == pytest.approx(f1.std() / f1.mean())
