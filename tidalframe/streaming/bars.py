"""Structured Streaming forms of the bar, state and alert operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Time bars of a stream of symbol, datetime (timestamp), event_id, price, size; a bar is out once the watermark passes it."""
    at = F.struct("datetime", "event_id")
    g = ticks.withWatermark("datetime", late).groupBy("symbol", F.window("datetime", f"{minutes} minutes"))
    agg = g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return agg.select("symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume")


def drift(values: DataFrame, delta: float = 0.005, threshold: float = 50.0) -> DataFrame:
    """Page-Hinkley alarms of a stream of name, datetime, x: two sums and a mean of state a name, rows in time order within a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, total, least = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        out = []
        for t, x in pd.concat(list(batches)).sort_values("datetime")[["datetime", "x"]].itertuples(index=False):
            n += 1
            mean += (x - mean) / n
            total += x - mean - delta
            least = min(least, total)
            if total - least > threshold:
                out.append((key[0], t, total - least))
                n, mean, total, least = 0, 0.0, 0.0, 0.0
        state.update((n, mean, total, least))
        yield pd.DataFrame(out, columns=["name", "datetime", "score"])

    return values.groupBy("name").applyInPandasWithState(update, "name string, datetime timestamp, score double", "n long, mean double, total double, least double", "append", "NoTimeout")


def alerts(found: DataFrame, every: str = "60 seconds") -> DataFrame:
    """The first alert of a name in each stretch of event time."""
    return found.withWatermark("datetime", every).withColumn("_slot", F.window("datetime", every)["start"]).dropDuplicatesWithinWatermark(["name", "_slot"]).drop("_slot")
