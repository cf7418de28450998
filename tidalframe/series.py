"""Ordered series: rows of one key in order of time, windowed in bounded blocks.

A window partitioned by key alone puts a whole key into one task.  Here every row
gets its index within its key (counts by key and hour, summed up, and a row number
within the hour), and a block is a stretch of indexes with as many rows before and
after it as an operator looks at.  Windows then partition by (key, block): results are
those of the whole series, and a key that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, TIME, INDEX, BLOCK = "symbol", "datetime", "_idx", "_blk"
BLOCK_ROWS = 65_536


def indexed(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """df with _idx, the row's place (from 0) within its key by time; equal times keep an order of the whole row."""
    hour = F.coalesce(F.unix_date(F.to_date(time)) * 24 + F.hour(time), F.lit(-(2**31)))  # no time comes first
    timed = df.withColumn("_hour", hour)
    counts = timed.groupBy(key, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_hour").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_hour").alias("_h"), F.coalesce(before, F.lit(0)).alias("_off"))
    rest = [c for c in df.columns if c not in (key, time)]
    here = W.partitionBy(key, "_hour").orderBy(time, *rest)
    placed = timed.withColumn("_rn", F.row_number().over(here))
    joined = placed.join(offsets, placed[key].eqNullSafe(F.col("_k")) & (placed["_hour"] == F.col("_h")))
    return joined.withColumn(INDEX, F.col("_off") + F.col("_rn") - 1).drop("_k", "_h", "_off", "_rn", "_hour")


def blocked(df: DataFrame, back: int, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """df (with _idx) with _blk and _core: each block also has the back rows before it and the ahead rows after it, with _core false."""
    rows = max(rows, back, ahead, 1)
    own = F.floor(F.col(INDEX) / rows)
    reach = lambda d: F.floor((F.col(INDEX) + d) / rows)
    blocks = F.array_distinct(F.filter(F.array(own, reach(back), reach(-ahead)), lambda b: b >= 0))
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn("_core", F.col(BLOCK) == own)


@dataclass(frozen=True)
class Rolling:
    """Expressions over one ordered window."""

    order: W

    @classmethod
    def of_blocks(cls, key: str = KEY) -> Rolling:
        return cls(W.partitionBy(key, BLOCK).orderBy(INDEX))

    o = property(lambda _: F.col("open"))
    h = property(lambda _: F.col("high"))
    l = property(lambda _: F.col("low"))  # noqa: E741
    c = property(lambda _: F.col("close"))
    v = property(lambda _: F.col("volume"))

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.order)

    def lead(self, c: Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.order)

    def rows(self, n: int) -> W:
        return self.order.rowsBetween(-(n - 1), 0)

    def full(self, n: int, held: Column, value: Column) -> Column:
        """value where the last n rows hold n values of held, else null."""
        return F.when(F.count(held).over(self.rows(n)) == n, value)

    def mean(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.avg(c).over(self.rows(n)))

    def sum(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.sum(c).over(self.rows(n)))

    def std(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.stddev_samp(c).over(self.rows(n)))

    def max(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.max(c).over(self.rows(n)))

    def min(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.min(c).over(self.rows(n)))

    def values(self, c: Column, n: int) -> Column:
        return self.full(n, c, F.collect_list(c).over(self.rows(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def log(c: Column) -> Column:
    """Natural logarithm, null at or below 0."""
    return F.when(c > 0, F.ln(c))


def with_features(df: DataFrame, features: dict[str, Column], back: int, ahead: int = 0, key: str = KEY, time: str = TIME, keep: list[str] | None = None) -> DataFrame:
    """df with columns that look back and ahead so many rows at most; expressions come from Rolling.of_blocks()."""
    base = blocked(indexed(df, key, time), back, ahead)
    cols = keep or df.columns
    return base.select(*cols, "_core", *[c.alias(n) for n, c in features.items()]).where("_core").drop("_core")
