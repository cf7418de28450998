"""Readers, manifests and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.sources import files
from tidalframe.sources.bars import ev_bars, ev_ticks
from tidalframe.streaming import bars as streaming


def test_paths_stay_in_their_folders():
    assert files.allowed("/data/raw/a.csv", ["/data/raw"])
    for bad in ("/data/raw/../x.csv", "~/x.csv", "/data/rawer/x.csv", "/etc/x"):
        with pytest.raises(files.PathNotAllowed):
            files.allowed(bad, ["/data/raw"])


def test_ingest_of_a_dirty_file(spark, tmp_path):
    p = f"{tmp_path}/mes_1m.csv"
    pd.DataFrame({"Date": ["2024-01-01 00:00:00", "2024-01-01 00:01:00", "bad"], "O": [1, 2, 3], "H": [0.5, 3, 3], "L": [2, 1, 3], "C": [1, "x", 3], "V": [5, 6, None]}).to_csv(p, index=False)
    got = files.ingest(spark, p, [str(tmp_path)]).toPandas()
    assert got.symbol.unique().tolist() == ["MES"] and len(got) == 2 and (got.high >= got.low).all()
    with pytest.raises(ValueError):
        files.load(spark, f"{tmp_path}/x.json", [str(tmp_path)])


def test_save_and_holdout_prune(spark, sf, tmp_path):
    b = files.holdout(ev_bars(spark, sf), "2024-01-10")
    files.save(b, f"{tmp_path}/b", {"n": 1}, ["part"])
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == b.count() and back.where("part = 'holdout'").agg(F.min("datetime")).first()[0] >= pd.Timestamp("2024-01-10")
    assert spark.read.text(f"{tmp_path}/b.meta").first()[0] == '{"n": 1}'
    assert files.features_of(["symbol", "open", "rsi_14", "label_h5", "ema_9"], exclude=["ema"]) == ["rsi_14"]


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    ticks = ev_ticks(spark, sf).withColumn("datetime", F.col("datetime").cast("timestamp"))
    src = f"{tmp_path}/ticks"
    ticks.orderBy("datetime").coalesce(1).write.parquet(src)
    stream = streaming.bars(spark.readStream.schema(ticks.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("streamed").toPandas()
    want = ev_bars(spark, sf).toPandas()
    m = got.merge(want, on=["symbol", "datetime"], suffixes=("", "_w"))
    assert len(m) == len(got) > 0.9 * len(want)
    for c in ("open", "high", "low", "close", "volume"):
        assert (m[c] - m[f"{c}_w"]).abs().max() < 1e-9


def test_drift_alarm_and_rate_limit(spark, tmp_path):
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i)).to_pydatetime(), 0.0 if i < 200 else 5.0) for i in range(400)]
    src = f"{tmp_path}/v"
    df = spark.createDataFrame(rows, "name string, datetime timestamp, x double")
    df.coalesce(1).write.parquet(src)
    q = streaming.drift(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("alarms").toPandas()
    assert len(got) >= 1 and (got.datetime >= pd.Timestamp("2024-01-01 00:03:20")).all()
    a = streaming.alerts(df)
    assert a.columns == ["name", "datetime", "x"]
