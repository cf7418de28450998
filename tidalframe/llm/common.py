"""Shared helpers: scratch tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.tables import scratch_root

#: A word of the contracts: a maximal run without space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of at most so many narrow rows (numbers, one short name) may be broadcast.
BROADCAST_ROWS = 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; every call gives another."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, narrow: bool = False, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs nothing.

    narrow: few short rows for the work that makes them; they go to an eighth as many files as a shuffle has partitions.
    path: a folder of scratch(), for a caller that empties it later.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame, path: str) -> None:
    """The files of df, stored at path, are deleted; an empty table takes their place."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows; else as it is, for a shuffled join. Give a stored table."""
    return F.broadcast(df) if df.count() <= rows else df


def id_text(c: str | Column) -> Column:
    """A null-safe text of an id, for hashing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
