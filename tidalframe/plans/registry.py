"""Queries by name, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def whole(sql: str, *names: str) -> str:
    """sql with the named columns as BIGINT."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)}) FROM ({sql})"


def rounded(df: DataFrame, digits: int = 6, raw: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, for comparison with another engine's sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in raw else F.col(c) for c, t in df.dtypes])
