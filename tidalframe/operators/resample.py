"""Bars from ticks and bars: by time, volume and traded value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..series import BLOCK, BLOCK_ROWS, INDEX, KEY, TIME, Rolling, indexed, with_features
from ..tables import kept


def time_bucket(t: str, minutes: int, origin: Column | None = None) -> Column:
    """The start of the bucket of so many minutes, counted from 1970 or from an origin."""
    secs = F.unix_seconds(F.col(t).cast("timestamp"))
    start = F.lit(0) if origin is None else F.unix_seconds(origin.cast("timestamp"))
    floor = F.floor((secs - start) / (minutes * 60)) * (minutes * 60) + start
    return F.timestamp_seconds(floor).cast("timestamp_ntz")


def bars_of_ticks(ticks: DataFrame, minutes: int) -> DataFrame:
    at = F.struct("datetime", "event_id")
    return ticks.groupBy(KEY, time_bucket(TIME, minutes).alias(TIME)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )


def resample(bars: DataFrame, minutes: int, anchor_first_day: bool = True, flags: tuple[str, ...] = ()) -> DataFrame:
    """Bars of so many minutes from smaller ones, left-closed and labelled by their start.

    Buckets start at midnight of a symbol's first day (the same as from 1970 unless
    the length does not divide a day).  Empty buckets give no bar; flags take their maximum.
    """
    if anchor_first_day and 1440 % minutes:
        first = bars.groupBy(KEY).agg(F.date_trunc("day", F.min(TIME)).alias("_first"))  # a row a symbol
        bars = bars.join(first, KEY)
        bucket = time_bucket(TIME, minutes, F.col("_first"))
    else:
        bucket = time_bucket(TIME, minutes)
    return bars.groupBy(KEY, bucket.alias("_t")).agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), F.sum("volume").alias("volume"),
        *[F.max(f).alias(f) for f in flags],
    ).withColumnRenamed("_t", TIME)


def _next(upto: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Where the next bar begins after one that begins at a row; more than the rows where it does not close. upto: sums of sizes up to each row."""
    n = len(upto)
    at = np.arange(n)
    before = np.concatenate([[0.0], upto[:-1]])
    close = np.maximum(np.searchsorted(upto, before + threshold, side="left"), at + least - 1)
    return np.where(close < n, close + 1, n + 1)


def bar_map(size: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block does to the open bar that enters it, by the row where that bar closes: sums up to the row, and bars closed, sum and rows of the open bar at the end.

    Rows from the first where even an empty bar would close on are not needed.
    """
    upto, n = np.cumsum(size), len(size)
    nxt = _next(upto, threshold, least).tolist()
    total = np.concatenate([[0.0], upto])
    closed, start = [0] * (n + 1), list(range(n + 1))
    for j in range(n - 1, -1, -1):
        if nxt[j] <= n:
            closed[j], start[j] = closed[nxt[j]] + 1, start[nxt[j]]
    last = min(max(int(np.searchsorted(upto, threshold, side="left")), least - 1) + 1, n)
    then = np.arange(1, last + 1)
    begun = np.array(start)[then]
    return upto[:last], np.array(closed)[then] + 1, total[n] - total[begun], n - begun


def bar_ids(size: np.ndarray, threshold: float, least: int, held: float = 0.0, rows: int = 0, bar: int = 0) -> np.ndarray:
    """The bar of each row: one closes when its sum reaches the threshold and it has `least` rows; what is over is not carried.

    held and rows are of the open bar that enters, whose number is bar.
    """
    upto, n = np.cumsum(size), len(size)
    nxt = _next(upto, threshold, least).tolist()
    begins = np.zeros(n, dtype=np.int64)
    j = max(int(np.searchsorted(upto, threshold - held, side="left")), least - rows - 1, 0) + 1
    while j < n:
        begins[j] = 1
        j = nxt[j]
    return bar + np.cumsum(begins)


def _accumulated(bars: DataFrame, size: Column, threshold: float, least: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Every reset depends on all rows before it: blocks make maps of the open bar that may enter them, a narrow pass over a symbol's
    maps (a row for each block, entries for about the rows of a bar) gives the one that does, and blocks number their rows.

    Sizes that are null or below 0 count as 0; bars of one time are in the order of the whole row.
    """
    kind = dict(bars.dtypes)[KEY]
    placed = kept(indexed(bars), "indexed")
    narrow = placed.select(KEY, INDEX, F.floor(F.col(INDEX) / block).alias(BLOCK), F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_size"))
    sizes = lambda p: p.sort_values(INDEX)["_size"].fillna(0).to_numpy()

    def mapped(p: pd.DataFrame) -> pd.DataFrame:
        x = sizes(p)
        upto, closed, held, rows = bar_map(x, threshold, least)
        return pd.DataFrame({KEY: [p[KEY].iloc[0]], BLOCK: [p[BLOCK].iloc[0]], "n": [len(x)], "total": [x.sum()], "upto": [upto.tolist()], "closed": [closed.tolist()], "held": [held.tolist()], "rows": [rows.tolist()]})

    def chained(p: pd.DataFrame) -> pd.DataFrame:
        p, out, held, rows, bar = p.sort_values(BLOCK), [], 0.0, 0, 0
        for r in p.itertuples(index=False):
            out.append((r[0], r[1], held, rows, bar))
            k = max(int(np.searchsorted(r.upto, threshold - held, side="left")), least - rows - 1, 0)
            if k < len(r.upto):
                held, rows, bar = float(r.held[k]), int(r.rows[k]), bar + int(r.closed[k])
            else:
                held, rows = held + r.total, rows + r.n
        return pd.DataFrame(out, columns=[KEY, BLOCK, "held", "rows", "bar"])

    def numbered(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p, e = p.sort_values(INDEX), e.iloc[0]
        return pd.DataFrame({KEY: p[KEY], INDEX: p[INDEX], "bar_id": bar_ids(p["_size"].to_numpy(), threshold, least, float(e["held"]), int(e["rows"]), int(e["bar"]))})

    maps = narrow.groupBy(KEY, BLOCK).applyInPandas(mapped, f"{KEY} {kind}, {BLOCK} long, n long, total double, upto array<double>, closed array<long>, held array<double>, rows array<long>")
    enter = maps.groupBy(KEY).applyInPandas(chained, f"{KEY} {kind}, {BLOCK} long, held double, rows long, bar long")
    ids = narrow.groupBy(KEY, BLOCK).cogroup(enter.groupBy(KEY, BLOCK)).applyInPandas(numbered, f"{KEY} {kind}, {INDEX} long, bar_id long")
    return placed.join(ids, [KEY, INDEX]).groupBy(KEY, "bar_id").agg(
        F.min(TIME).alias(TIME), F.min_by("open", INDEX).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", INDEX).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("close") * F.col("volume")).alias("dollar_value"), F.count(F.lit(1)).alias("n_bars"),
    )


def volume_bars(bars: DataFrame, threshold: float, least: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    return _accumulated(bars, F.col("volume"), threshold, least, block).drop("dollar_value")


def dollar_bars(bars: DataFrame, threshold: float, least: int = 1, typical: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    price = (F.col("high") + F.col("low") + F.col("close")) / 3 if typical else F.col("close")
    return _accumulated(bars, price * F.col("volume"), threshold, least, block)


def estimate_count(bars: DataFrame, threshold: float, dollar: bool = False) -> DataFrame:
    size = F.col("close") * F.col("volume") if dollar else F.col("volume")
    return bars.groupBy(KEY).agg(F.floor(F.sum(size) / threshold).cast("long").alias("bars"))


def bar_metadata(built: DataFrame) -> DataFrame:
    """Compression and input bars a bar of volume or dollar bars."""
    n = F.count(F.lit(1))
    return built.groupBy(KEY).agg(n.alias("bars_out"), F.sum("n_bars").alias("bars_in"), (F.sum("n_bars") / n).alias("compression"), F.min("n_bars").alias("min_bars"), F.max("n_bars").alias("max_bars"))


BUILDERS = {"time": resample, "volume": volume_bars, "dollar": dollar_bars}


def build_bars(bars: DataFrame, kind: str, **options) -> DataFrame:
    if kind not in BUILDERS:
        raise ValueError(f"no bars of kind {kind!r}; there are {', '.join(BUILDERS)}")
    return BUILDERS[kind](bars, **options)


def as_of(base: DataFrame, other: DataFrame, columns: list[str], shift: int = 1) -> DataFrame:
    """base with columns of other: at time t those of the row `shift` rows before the last one of other that is not later than t.

    One shuffle by symbol and day of the union of both; what carries over from day
    to day is one row a symbol and day, carried forward on its own.
    """
    r = Rolling.of_blocks()
    held = F.struct(*[r.lag(F.col(x), shift).alias(x) for x in columns]) if shift else F.struct(*columns)
    right = with_features(other, {"_right": held}, shift, keep=[KEY, TIME]) if shift else other.select(KEY, TIME, held.alias("_right"))
    right = right.withColumn("_side", F.lit(0))
    left_cols = [x for x in base.columns if x not in (KEY, TIME)]
    left = base.select(KEY, TIME, F.lit(1).alias("_side"), F.struct(*left_cols).alias("_left"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_day", F.to_date(TIME))
    ends = right.groupBy(KEY, F.to_date(TIME).alias("_day")).agg(F.max_by(F.struct(F.lit(True).alias("is"), F.col("_right").alias("r")), TIME).alias("_end"))
    days = both.select(KEY, "_day").distinct().join(ends, [KEY, "_day"], "left")
    carried = F.last("_end", ignorenulls=True).over(W.partitionBy(KEY).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select(KEY, "_day", carried.alias("_before"))
    here = W.partitionBy(KEY, "_day").orderBy(TIME, "_side").rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(F.col("_side") == 0, F.struct(F.lit(True).alias("is"), F.col("_right").alias("r"))), ignorenulls=True).over(here)
    out = both.withColumn("_own", own).where("_side = 1").join(days, [KEY, "_day"])
    got = F.coalesce("_own", "_before")
    return out.select(KEY, TIME, *[F.col(f"_left.{x}").alias(x) for x in left_cols], *[got["r"][x].alias(x if x not in base.columns else f"{x}_other") for x in columns])
