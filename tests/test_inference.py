"""Batch predictions: one poisoned batch of many under all three policies, batches that do not depend on partitions."""

import numpy as np
import pandas as pd
import pytest

from tidalframe.operators import inference


def model(x):
    if (x["a"] == 137).any():
        raise ValueError("poisoned")
    z = np.column_stack([x["a"] % 3 == k for k in range(3)]) * 1.0 + 0.5
    return z / z.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def rows(spark):
    t = pd.date_range("2024-01-01", periods=250, freq="min")
    return spark.createDataFrame(pd.DataFrame({"symbol": "s", "datetime": t, "a": np.arange(250.0)})).repartition(7)


@pytest.mark.parametrize("policy", ["warn", "skip"])
def test_a_failed_batch_is_listed_and_left_out(rows, policy):
    def run():
        return inference.predict_batches(rows, model, ["a"], 20, policy, keep=("symbol", "datetime", "a"))

    if policy == "warn":
        with pytest.warns(UserWarning, match="1 batches failed.*poisoned"):
            out = run()
    else:
        out = run()
    assert [tuple(r) for r in out.failed.collect()] == [(6, 120, 20, "ValueError: poisoned")]
    p = out.predictions.orderBy("row_id").toPandas()
    assert list(p.row_id) == [i for i in range(250) if i // 20 != 6] and (p.a == p.row_id).all() and (p.batch == p.row_id // 20).all()
    assert (p.prediction == p.a % 3 - 1).all() and np.allclose(p.confidence, 0.6) and np.allclose(p[list(inference.CLASSES)].sum(axis=1), 1.0)
    parts = list(inference.chunks(out.predictions))
    assert [len(x) for x in parts] == [20] * 11 + [10] and pd.concat(parts).row_id.is_monotonic_increasing


def test_raise_ends_the_job(rows):
    with pytest.raises(Exception, match="poisoned"):
        inference.predict_batches(rows, model, ["a"], 20, "raise")
    assert inference.predict_batches(rows.where("a < 100"), model, ["a"], 20, "raise").predictions.count() == 100


def test_wrong_shapes_empty_tables_and_unknown_policies(rows):
    bad = inference.predict_batches(rows, lambda x: np.ones((len(x), 2)), ["a"], 200, "skip")
    assert bad.predictions.count() == 0 and [r.start for r in bad.failed.orderBy("batch").collect()] == [0, 200]
    assert inference.predict_batches(rows.limit(0), model, ["a"]).predictions.count() == 0
    with pytest.raises(ValueError, match="no policy"):
        inference.predict_batches(rows, model, ["a"], policy="hope")
