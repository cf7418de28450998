"""Normalisation by session and indicators of larger timeframes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, recursive

from ..quantiles import quantiles, renamed, same
from ..series import KEY, TIME, Rolling, ratio, with_features
from .resample import as_of, resample


def session_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """session, name, mean, std, median, iqr (0 counts as 1) over the rows of each session; a row of an overlap counts for both."""
    flags = clock.session_flags()
    member = F.explode(F.filter(F.array(*[F.when(flags[f"is_{s}"] == 1, F.lit(s)) for s in clock.SESSIONS]), lambda s: s.isNotNull()))
    x = df.select(member.alias("session"), *columns)
    rows = x.select("session", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("session", "e.*")
    keys = ["session", "name"]
    q = [F.col("q")[i] for i in range(3)]
    one = lambda c: F.when(c > 0, c).otherwise(1.0)
    s = rows.groupBy(*keys).agg(F.avg("x").alias("mean"), one(F.stddev_samp("x")).alias("std"))
    three = renamed(quantiles(rows, keys, "x", [0.25, 0.5, 0.75]), keys)
    return s.join(three, same(keys), "left").select(*s.columns, q[1].alias("median"), one(q[2] - q[0]).alias("iqr"))


def session_apply(df: DataFrame, fitted: DataFrame, columns: list[str], method: str = "zscore", suffix: str = "_session_norm", volatility: str | None = None) -> DataFrame:
    """Each column against its session's figures; rows of an overlap take the later session, rows outside stay null.

    method: "zscore", "robust", or "volatility", which divides by the session's mean of the column `volatility` (fitted, too) unless that is 0.
    """
    if method == "volatility" and not volatility:
        raise ValueError("name the column of the volatility")
    columns, made_of = list(dict.fromkeys([*columns, *([volatility] if volatility else [])])), columns
    wide = fitted.groupBy("session").pivot("name", columns).agg(F.first(F.struct("mean", "std", "median", "iqr")))
    out = df.withColumn("_session", clock.session()).join(F.broadcast(wide.select(F.col("session").alias("_s"), *[F.col(c).alias(f"_f_{c}") for c in columns])), F.col("_session") == F.col("_s"), "left")  # a row a session
    if method == "volatility":
        mean = F.col(f"_f_{volatility}.mean")
        made = {f"{c}{suffix}": F.when(F.col("_session").isNotNull(), F.when(mean != 0, F.col(c) / mean).otherwise(F.col(c))) for c in made_of}
    else:
        center, scale = {"zscore": ("mean", "std"), "robust": ("median", "iqr")}[method]
        made = {f"{c}{suffix}": (F.col(c) - F.col(f"_f_{c}.{center}")) / F.col(f"_f_{c}.{scale}") for c in made_of}
    return out.withColumns(made).drop("_session", "_s", *[f"_f_{c}" for c in columns])


def by_session(df: DataFrame, columns: list[str], method: str = "zscore", volatility: str | None = None, suffix: str = "_session_norm") -> DataFrame:
    """Fitted and applied to the same rows."""
    names = list(dict.fromkeys([*columns, *([volatility] if volatility else [])]))
    return session_apply(df, session_fit(df, names), columns, method, suffix, volatility)


def session_ratios(df: DataFrame, column: str) -> DataFrame:
    """session, ratio: the mean of a column in the session over its mean in all rows."""
    f = session_fit(df, [column]).select("session", "mean")
    total = df.agg(F.avg(column).alias("_m"))
    return f.crossJoin(F.broadcast(total)).select("session", (F.col("mean") / F.col("_m")).alias("ratio"))  # one row


def mtf_indicators(df: DataFrame, suffix: str) -> DataFrame:
    """Indicators of a larger timeframe's bars, of the bar itself: plain-mean RSI (0 without losses) and ATR, means, band position and MACD histogram."""
    r = Rolling.of_blocks()
    d = r.c - r.lag(r.c)
    gain, loss = (r.mean(F.when(d.isNotNull(), F.greatest(x, F.lit(0.0))), 14) for x in (d, -d))
    before = r.lag(r.c)
    tr = F.greatest(r.h - r.l, F.abs(r.h - before), F.abs(r.l - before))
    m, s = r.mean(r.c, 20), r.std(r.c, 20)
    made = {
        f"sma_20_{suffix}": m,
        f"sma_50_{suffix}": r.mean(r.c, 50),
        f"rsi_14_{suffix}": F.when(loss == 0, 0.0).otherwise(F.lit(100.0) - F.lit(100.0) / (ratio(gain, loss) + 1)),
        f"atr_14_{suffix}": r.mean(tr, 14),
        f"bb_position_{suffix}": ratio(r.c - (m - s * 2), s * 4),
        f"price_to_sma_20_{suffix}": ratio(r.c, m) - 1,
    }

    def make(p):
        c = p["close"].to_numpy(dtype=float)
        line = recursive.ewm(c, 12) - recursive.ewm(c, 26)
        ok = ~np.isnan(line)
        signal = np.full(len(c), np.nan)
        signal[ok] = recursive.ewm(line[ok], 9)
        return {f"ema_9_{suffix}": recursive.ewm(c, 9), f"ema_21_{suffix}": recursive.ewm(c, 21), f"macd_hist_{suffix}": line - signal}

    plain = with_features(df, made, 51, keep=[KEY, TIME])
    ewms = recursive.scanned(df, ["close"], make, [f"ema_9_{suffix}", f"ema_21_{suffix}", f"macd_hist_{suffix}"], recursive.WARM * 26, [KEY, TIME])
    return plain.join(ewms, [KEY, TIME])


def with_timeframes(df: DataFrame, minutes: list[int], base_minutes: int, least: int = 30) -> DataFrame:
    """df with the last finished bar's indicators of each larger timeframe that has enough bars."""
    if bad := [m for m in minutes if m <= base_minutes or m % base_minutes]:
        raise ValueError(f"{bad} are no whole multiples of {base_minutes} minutes")
    out = df
    for m in minutes:
        bars = resample(df, m)
        if bars.count() < least:
            continue
        suffix = f"{m}m" if m < 60 else f"{m // 60}h" if m < 1440 else f"{m // 1440}d"
        ind = mtf_indicators(bars, suffix)
        out = as_of(out, ind, [c for c in ind.columns if c not in (KEY, TIME)])
    return out
