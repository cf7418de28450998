"""Predictions of a Python model over large tables, in batches of bounded size with a policy for those that fail.

Rows are numbered by time; a batch is a stretch of numbers, so the same table has the same batches whatever its partitions.
Each batch is one call of the model in one task.  All batches are written to the scratch folder once, with their failures beside
them, so neither table runs the model again.

Defined cases: an empty table has no batches; nulls reach the model as they are; a model that gives other than a row of class
probabilities for each row fails its batch.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import TIME
from ..tables import kept
from .splits import positions

BATCH_ROWS = 10_000
POLICIES = ("warn", "raise", "skip")
# Names of the classes' probabilities, of labels -1, 0 and 1.
CLASSES = ("prob_short", "prob_neutral", "prob_long")


class Predicted(NamedTuple):
    """predictions: row_id, batch, what was kept, prediction, the probabilities, confidence; failed: batch, start, rows, error."""

    predictions: DataFrame
    failed: DataFrame


def predict_batches(df: DataFrame, model: Callable[[pd.DataFrame], np.ndarray], columns: list[str], batch_rows: int = BATCH_ROWS, policy: str = "warn", keep: tuple[str, ...] = (TIME,)) -> Predicted:
    """model gets the columns of a batch, in order of rows, and gives an array (rows, 3) of probabilities.

    raise: the first failure ends the job; warn and skip leave the batch out and list it as failed, warn also says so on the driver.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {', '.join(POLICIES)}")
    kinds = dict(df.dtypes)
    held = list(dict.fromkeys(keep))
    out = ["row_id", "batch", *held, "prediction", *CLASSES, "confidence", "start", "rows", "error"]
    schema = ", ".join(["row_id long", "batch long", *(f"`{c}` {kinds[c]}" for c in held), "prediction int", *(f"{c} double" for c in CLASSES), "confidence double", "start long", "rows long", "error string"])

    def texts(p: pd.DataFrame) -> pd.DataFrame:
        return p.reindex(columns=out).astype({c: object for c in ["error", *(c for c in held if kinds[c] == "string")]})

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row_id").reset_index(drop=True)
        batch = int(p["batch"].iloc[0])
        try:
            probs = np.asarray(model(p[columns]), dtype=float)
            if probs.shape != (len(p), len(CLASSES)):
                raise ValueError(f"the model gave {probs.shape} for {len(p)} rows")
        except Exception as e:  # the policy's own matter; anything else ends the task
            if policy == "raise":
                raise
            failed = p[["row_id", "batch", *held]].head(1).assign(start=batch * batch_rows, rows=len(p), error=f"{type(e).__name__}: {e}")
            return texts(failed)
        made = p[["row_id", "batch", *held]].assign(prediction=probs.argmax(axis=1) - 1, confidence=probs.max(axis=1), **{c: probs[:, k] for k, c in enumerate(CLASSES)})
        return texts(made)

    rows = positions(df.select(*dict.fromkeys([TIME, *held, *columns]))).withColumn("batch", F.floor(F.col("row_id") / batch_rows))
    found = kept(rows.groupBy("batch").applyInPandas(run, schema), "predictions")
    failed = found.where("error is not null").select("batch", "start", "rows", "error")
    if policy == "warn" and (n := failed.count()):
        warnings.warn(f"{n} batches failed, the first: {failed.orderBy('batch').first()['error']}", stacklevel=2)
    return Predicted(found.where("error is null").drop("start", "rows", "error"), failed)


def chunks(predictions: DataFrame) -> Iterator[pd.DataFrame]:
    """The predictions batch by batch, in order; the driver holds a partition at a time."""
    ordered = predictions.repartitionByRange("batch").sortWithinPartitions("batch", "row_id")
    for _, rows in groupby(ordered.toLocalIterator(prefetchPartitions=True), key=lambda r: r["batch"]):
        yield pd.DataFrame([r.asDict() for r in rows])
