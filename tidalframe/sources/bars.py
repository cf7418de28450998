"""Bar views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def li_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem by return flag: price is the unit price, volume the quantity, a bar's order that of the whole row."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    t = t.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"), price.alias("p"), row.alias("r"), F.col("l_quantity").alias("q")).where("p > 0")
    return t.groupBy("symbol", "datetime").agg(
        F.min_by("p", "r").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "r").alias("close"), F.sum("q").alias("volume")
    )


LI_BARS_SQL = """li AS (SELECT l_returnflag AS symbol, l_shipdate AS datetime, l_extendedprice / nullif(l_quantity, 0.0) AS p, l_quantity AS q,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_extendedprice / nullif(l_quantity, 0.0) > 0),
b AS (SELECT symbol, datetime,
  first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS close, sum(q) AS volume FROM li GROUP BY ALL)"""


def ev_ticks(spark: SparkSession, sf_dir: str, by_type: bool = True) -> DataFrame:
    """symbol, datetime, event_id, price, size of events with a positive value; size is 1."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    return t.select(symbol.alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("datetime"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def ev_bars(spark: SparkSession, sf_dir: str, minutes: int = 60, by_type: bool = True) -> DataFrame:
    from ..operators.resample import bars_of_ticks

    return bars_of_ticks(ev_ticks(spark, sf_dir, by_type), minutes)


def ev_bars_sql(minutes: int = 60, by_type: bool = True) -> str:
    symbol = "event_type" if by_type else "'ALL'"
    return f"""b AS (SELECT {symbol} AS symbol, time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '1970-01-01') AS datetime,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value > 0 GROUP BY ALL)"""
