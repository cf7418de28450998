"""Queries of sources, splits by date and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.bars import LI_BARS_SQL, li_bars
from .registry import query


@query("holdout_split", f"WITH {LI_BARS_SQL} SELECT symbol, datetime, CASE WHEN datetime < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'holdout' END AS part FROM b")
def holdout_split(spark, d):
    return files.holdout(li_bars(spark, d), "1996-01-01").select("symbol", "datetime", "part")


@query("dataset_fingerprint", f"WITH {LI_BARS_SQL} SELECT count(*) AS rows, 7 AS n_columns, 'close,datetime,high,low,open,symbol,volume' AS names, min(datetime) AS first_time, max(datetime) AS last_time FROM b")
def dataset_fingerprint(spark, d):
    return files.fingerprint(li_bars(spark, d)).drop("schema_hash")


@query("manifest_diff", "SELECT * FROM (VALUES ('bars', 'modified'), ('early', 'unchanged'), ('gone', 'removed'), ('fresh', 'added')) t(name, status)")
def manifest_diff(spark, d):
    b = li_bars(spark, d)
    early = b.where("datetime < TIMESTAMP_NTZ '1994-01-01'")
    old = files.manifest({"bars": b, "early": early, "gone": early})
    return files.compare(old, files.manifest({"bars": b.withColumn("volume", F.col("volume") + 1), "early": early.repartition(3), "fresh": early}))


@query("artifact_check", "SELECT * FROM (VALUES ('early', true), ('bars', false)) t(name, same)")
def artifact_check(spark, d):
    b = li_bars(spark, d)
    early = b.where("datetime < TIMESTAMP_NTZ '1994-01-01'")
    return files.verify(files.manifest({"bars": b, "early": early}), {"bars": early, "early": early})


@query("forecasting_export", f"WITH {LI_BARS_SQL} SELECT symbol AS unique_id, datetime AS ds, close AS y, 1.0::DOUBLE AS sample_weight, volume FROM b")
def forecasting_export(spark, d):
    return files.forecasting(li_bars(spark, d), "close", features=["volume"])


@query("symbol_union", f"WITH {LI_BARS_SQL} SELECT symbol, count(*) AS n FROM b GROUP BY symbol")
def symbol_union(spark, d):
    b = li_bars(spark, d)
    return b.where("symbol = 'A'").unionByName(b.where("symbol <> 'A'")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
