"""Queries of the stream operators, run over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import shifts
from .registry import query, rounded


def _values(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("datetime"), F.col("value").alias("x"))


@query("adwin_shifts")
def adwin_shifts(spark, d):
    return shifts.adwin(_values(spark, d), 0.3)


@query("half_shifts")
def half_shifts(spark, d):
    return shifts.halves(_values(spark, d), 0.05, most=200)


@query("alert_limit", """WITH RECURSIVE e AS (SELECT event_type AS name, ts AS datetime, value AS metric, CASE WHEN value >= 150 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS severity FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY datetime, severity) AS i FROM e WHERE severity IN ('high', 'critical')),
s(name, i, last, out) AS (SELECT name, i, datetime, true FROM g WHERE i = 1 UNION ALL SELECT g.name, g.i, CASE WHEN g.datetime >= s.last + INTERVAL 4 HOUR THEN g.datetime ELSE s.last END, g.datetime >= s.last + INTERVAL 4 HOUR FROM s JOIN g ON g.name = s.name AND g.i = s.i + 1)
SELECT name, datetime, severity, round(metric, 6) AS metric FROM g JOIN s USING (name, i) WHERE out""")  # fmt: skip
def alert_limit(spark, d):
    x = F.col("x")
    kind = F.when(x >= 150, "critical").when(x >= 100, "high").when(x >= 50, "medium").otherwise("low")
    found = _values(spark, d).select("name", "datetime", kind.alias("severity"), x.alias("metric"))
    return rounded(shifts.alerts(found, "high", 4 * 3600.0).withColumn("datetime", F.col("datetime").cast("timestamp_ntz")))
