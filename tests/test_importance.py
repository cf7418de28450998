"""Permutation importance against permuted copies of the table, hybrid ranks, and columns chosen over folds."""

import math

import numpy as np
import pandas as pd

from tidalframe.operators import models, splits


def frame(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    t = pd.date_range("2024-01-01", periods=n, freq="min")
    return pd.DataFrame({"symbol": "s", "datetime": t, "a": x[:, 0], "b": x[:, 1], "none": x[:, 2], "y": y})


def test_permutations_are_bijections():
    for n in (1, 2, 7, 240, 10**6):
        for _, _, a, b in models.permutations(n, ["x", "y"], 5, 3):
            assert math.gcd(a, n) == 1 and 0 <= b < max(n, 1)
    n = 240
    assert all(sorted((a * j + b) % n for j in range(n)) == list(range(n)) for _, _, a, b in models.permutations(n, ["x", "y"], 5, 3))
    assert models.permutations(10**13, ["x"], 1, 3)[0][2] * 10**13 < 2**63


def test_equals_permuted_copies(spark):
    p = frame()
    columns = ["a", "b", "none"]
    df = spark.createDataFrame(p)
    model = models._forest(df, columns, "y", 5, 3, 42)
    got = {r["name"]: (r["mean"], r["std"]) for r in models.permuted_accuracy(df.repartition(5), model, columns, "y", repeats=2).collect()}

    def right(q):
        out = model.transform(models._assembled(spark.createDataFrame(q), columns))
        return out.where("prediction = y").count() / len(q)

    base, lost = right(p), {c: [] for c in columns}
    for i, _, a, b in models.permutations(len(p), columns, 2, 42):
        q = p.copy()
        values = np.empty(len(p))
        values[(a * np.arange(len(p)) + b) % len(p)] = p[columns[i]]
        q[columns[i]] = values
        lost[columns[i]].append(base - right(q))
    for c in columns:
        assert abs(got[c][0] - np.mean(lost[c])) < 1e-9 and abs(got[c][1] - np.std(lost[c])) < 1e-9
    assert got["a"][0] > 0.2 and got["a"][0] > got["none"][0]


def test_hybrid_ranks_and_frequency(spark):
    df = spark.createDataFrame(frame())
    columns = ["a", "b", "none"]
    opt = {"trees": 5, "depth": 3}
    mdi = {r["name"]: r["importance"] for r in models.importance(df, columns, "y", **opt).collect()}
    mda = {r["name"]: r["importance"] for r in models.permutation_importance(df, columns, "y", repeats=2, **opt).collect()}
    want = {c: (pd.Series(mdi).rank()[c] + pd.Series(mda).rank()[c]) / 2 for c in columns}
    assert {r["name"]: r["importance"] for r in models.hybrid_importance(df, columns, "y", repeats=2, **opt).collect()} == want
    often = models.chosen_often(df, splits.purged_kfold(df, 2, 5, 5), columns, "y", 1, method="mda", repeats=2, **opt).collect()
    assert [(r["name"], r.folds, r.share, r.keep) for r in often] == [("a", 2, 1.0, True)]
