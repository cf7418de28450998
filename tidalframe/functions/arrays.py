"""Window features over the array of a bounded frame: wavelets, Hurst exponents, regimes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Rolling, ratio, with_features

# The decomposition low-pass filter of the Daubechies wavelet of four vanishing moments.
DB4 = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)


def dwt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(approximation, detail) of each row with symmetric padding."""
    lo = np.array(DB4)
    hi = lo[::-1] * np.where(np.arange(len(lo)) % 2 == 0, -1.0, 1.0)
    k = len(lo)
    padded = np.pad(x, ((0, 0), (k - 1, k - 1)), mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1)[:, 1::2]
    return windows @ lo[::-1], windows @ hi[::-1]


def wavedec(x: np.ndarray, level: int) -> list[np.ndarray]:
    """[approximation, detail of the coarsest level, ..., of the finest]."""
    details = []
    for _ in range(level):
        x, d = dwt(x)
        details.append(d)
    return [x, *details[::-1]]


def _wavelet_rows(x: np.ndarray, level: int) -> dict[str, np.ndarray]:
    a, *d = wavedec(x, level)
    out = {"approx": a[:, -1]} | {f"d{level - i}": c[:, -1] for i, c in enumerate(d)}
    energy = {"approx": (a**2).sum(1)} | {f"d{level - i}": (c**2).sum(1) for i, c in enumerate(d)}
    out |= {f"energy_{k}": np.log1p(v) for k, v in energy.items()}
    total = sum(energy.values())
    out["energy_ratio"] = np.where(total > 1e-10, energy["approx"] / np.maximum(total, 1e-10), 0.0)
    one = dwt(x)[1]
    out["volatility"] = np.median(np.abs(one - np.median(one, axis=1, keepdims=True)), axis=1) / 0.6745
    sd = x.std(1)
    slope = (a[:, -1] - a[:, 0]) / a.shape[1]
    out["trend_strength"] = np.where(sd > 1e-10, slope / np.maximum(sd, 1e-10), 0.0)
    out["trend_direction"] = np.sign(slope)
    return out


def wavelets(df: DataFrame, column: str = "close", window: int = 64, level: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Coefficients, energies, volatility and trend of each full window, as of the bar before; one vectorised step a batch."""
    r = Rolling.of_blocks()
    names = ["approx", *[f"d{k}" for k in range(level, 0, -1)], "energy_approx", *[f"energy_d{k}" for k in range(level, 0, -1)], "energy_ratio", "volatility", "trend_strength", "trend_direction"]
    schema = ", ".join(f"{n} double" for n in names)

    @F.pandas_udf(schema)
    def decompose(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = pd.DataFrame(np.nan, index=s.index, columns=names)
            ok = s.notna().to_numpy()
            if ok.any():
                for k, v in _wavelet_rows(np.stack(s[ok].to_list()).astype(float), level).items():
                    out.loc[ok, k] = v
            yield out

    cols = keep or df.columns
    f = with_features(df, {"_w": r.values(r.lag(F.col(column)), window)}, window + 1, keep=cols)
    f = f.withColumn("_d", decompose("_w"))
    return f.select(*cols, *[F.when(F.isnan(f"_d.{n}"), None).otherwise(F.col(f"_d.{n}")).alias(f"wavelet_{column}_{n}") for n in names])


def normalised(df: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """Each column less its expanding mean over its expanding deviation, per symbol, from sums by day carried forward."""
    from pyspark.sql import Window as W

    from ..series import INDEX, KEY, TIME, indexed

    base = indexed(df).withColumn("_day", F.to_date(TIME))
    whole = W.partitionBy(KEY).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    here = W.partitionBy(KEY, "_day").orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    day = base.groupBy(KEY, "_day").agg(*[f(F.col(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(x * x)))])
    names = [f"_{n}_{c}" for c in columns for n in "nsq"]
    day = day.select(KEY, "_day", *[F.coalesce(F.sum(n).over(whole), F.lit(0.0)).alias(n) for n in names])
    out = base.join(day, [KEY, "_day"])
    made = {}
    for c in columns:
        x = F.col(c)
        n = F.col(f"_n_{c}") + F.count(x).over(here)
        m = (F.col(f"_s_{c}") + F.coalesce(F.sum(x).over(here), F.lit(0.0))) / F.nullif(n, F.lit(0.0))
        var = (F.col(f"_q_{c}") + F.coalesce(F.sum(x * x).over(here), F.lit(0.0))) / F.nullif(n, F.lit(0.0)) - m * m
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        made[c] = F.when(n >= least, F.when(sd <= 1e-10, 0.0).otherwise(ratio(x - m, sd)))
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def hurst_rows(x: np.ndarray, low: int = 2, high: int = 20) -> np.ndarray:
    """The R/S exponent of each row of prices: slope of log mean(R/S) over log lag, in [0, 1]."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.diff(np.log(x), axis=1)
        n = ret.shape[1]
        logs, values = [], []
        for lag in range(low, high + 1):
            k = n // lag
            seg = ret[:, : k * lag].reshape(len(x), k, lag)
            dev = np.cumsum(seg - seg.mean(2, keepdims=True), axis=2)
            rng, sd = dev.max(2) - dev.min(2), seg.std(2, ddof=1)
            rs = np.where(sd > 0, rng / sd, np.nan)
            logs.append(math.log(lag))
            values.append(np.log(np.nanmean(rs, axis=1)))
        y, t = np.stack(values, 1), np.array(logs)
        ok = np.isfinite(y)
        w = ok.sum(1)
        y0 = np.where(ok, y, 0)
        tm, ym = (ok * t).sum(1) / w, y0.sum(1) / w
        slope = (np.where(ok, (t - tm[:, None]) * (y0 - ym[:, None]), 0)).sum(1) / (np.where(ok, (t - tm[:, None]) ** 2, 0)).sum(1)
        return np.where(w >= 2, np.clip(slope, 0, 1), np.nan)


def hurst(df: DataFrame, window: int = 100, keep: list[str] | None = None) -> DataFrame:
    """hurst and structure (mean_reverting under 0.4, trending over 0.6, else random) of the last `window` closes."""
    r = Rolling.of_blocks()

    @F.pandas_udf("double")
    def exponent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series(np.nan, index=s.index)
            ok = s.notna().to_numpy()
            if ok.any():
                out[ok] = hurst_rows(np.stack(s[ok].to_list()).astype(float))
            yield out

    cols = keep or df.columns
    f = with_features(df, {"_w": r.values(r.c, window)}, window, keep=cols).withColumn("_h", exponent("_w"))
    h = F.when(~F.isnan("_h"), F.col("_h"))
    return f.select(*cols, h.alias("hurst"), F.when(h < 0.4, "mean_reverting").when(h > 0.6, "trending").when(h.isNotNull(), "random").alias("structure"))


def quantile_regime(r: Rolling, x: Column, window: int = 100, low: float = 0.25, high: float = 0.75) -> Column:
    """low / normal / high of a value against its own rolling quartiles (from one value on)."""
    frame = r.rows(window)
    q1, q3 = (F.percentile(x, p).over(frame) for p in (low, high))
    return F.when(x.isNull(), None).when(x <= q1, "low").when(x >= q3, "high").otherwise("normal")


def volatility_flag(r: Rolling, x: Column, window: int = 100) -> Column:
    return F.coalesce((x > F.percentile(x, 0.5).over(r.rows(window))).cast("int"), F.lit(0))


def trend_flag(r: Rolling, short: int = 50, long: int = 200) -> Column:
    p, a, b = r.lag(r.c), r.mean(r.lag(r.c), short), r.mean(r.lag(r.c), long)
    return F.when((p > a) & (a > b), 1).when((p < a) & (a < b), -1).otherwise(0)


def composite(columns: list[str], separator: str = "_") -> Column:
    return F.concat_ws(separator, *columns)


def encoded(df: DataFrame, column: str) -> DataFrame:
    """df with {column}_code: the alphabetical rank of each value that occurs, from 0."""
    from pyspark.sql import Window as W

    kinds = df.where(F.col(column).isNotNull()).select(column).distinct()  # a row a regime
    return df.join(F.broadcast(kinds.withColumn(f"{column}_code", F.row_number().over(W.orderBy(column)) - 1)), column, "left")


def regime_summary(df: DataFrame, column: str, key: str = "symbol") -> DataFrame:
    """key, regime, n, share, runs and mean length of a run."""
    from pyspark.sql import Window as W

    r = Rolling.of_blocks()
    f = with_features(df, {"_before": r.lag(F.col(column))}, 1)
    f = f.withColumn("_new", (~F.col("_before").eqNullSafe(F.col(column))).cast("int"))
    g = f.groupBy(key, F.col(column).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("runs"))
    return g.select(key, "regime", "n", (F.col("n") / F.sum("n").over(W.partitionBy(key))).alias("share"), "runs", (F.col("n") / F.col("runs")).alias("mean_run"))


def obv(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """On-balance volume as of the bar before: sums by day carried forward, then within the day."""
    from pyspark.sql import Window as W

    from ..series import INDEX, KEY, TIME

    r = Rolling.of_blocks()
    cols = keep or df.columns
    step = F.signum(r.c - r.lag(r.c)) * r.v
    f = with_features(df, {"_step": r.lag(F.coalesce(step, F.lit(0.0))), INDEX: F.col(INDEX)}, 2).withColumn("_day", F.to_date(TIME))
    day = f.groupBy(KEY, "_day").agg(F.sum("_step").alias("_s"))
    day = day.select(KEY, "_day", F.coalesce(F.sum("_s").over(W.partitionBy(KEY).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))
    here = F.sum("_step").over(W.partitionBy(KEY, "_day").orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0))
    return f.withColumn("_here", here).join(day, [KEY, "_day"]).select(*cols, F.when(F.col("_step").isNotNull(), F.col("_b") + F.coalesce("_here", F.lit(0.0))).alias("obv"))


def vwap(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The day's volume-weighted typical price and the close against it, as of the bar before."""
    from pyspark.sql import Window as W

    from ..series import KEY, TIME

    cols = keep or df.columns
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    day = W.partitionBy(KEY, F.to_date(TIME)).orderBy(TIME).rowsBetween(W.unboundedPreceding, 0)
    v = F.coalesce(ratio(F.sum(tp * F.col("volume")).over(day), F.sum("volume").over(day)), tp)
    r = Rolling.of_blocks()
    f = df.withColumn("_v", v)
    return with_features(f, {"vwap": r.lag(F.col("_v")), "price_to_vwap": ratio(r.lag(r.c), r.lag(F.col("_v"))) - 1}, 1, keep=cols)
