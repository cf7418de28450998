"""Market regimes: the basic flags, the detectors of the advanced set, and routing of rows to models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, recursive, volatility
from ..series import Rolling, with_features
from .review import trend_by_strength


def basic(df: DataFrame, window: int = 100) -> DataFrame:
    """df with volatility_flag (hvol_20 over its rolling median: 1, else 0) and trend_flag (-1, 0, 1)."""
    r = Rolling.of_blocks()
    f = with_features(df, {"_hvol": volatility.historical(r, (20,))["hvol_20"], "trend_flag": arrays.trend_flag(r)}, 202)
    return with_features(f, {"volatility_flag": arrays.volatility_flag(r, F.col("_hvol"), window)}, window, keep=[*df.columns, "trend_flag"])


def by_range(df: DataFrame, period: int = 14, window: int = 100) -> DataFrame:
    """df with volatility: low, normal or high, Wilder's average range against its own rolling quartiles; null in the warm-up."""
    cols = list(df.columns)
    make = lambda p: {"_atr": recursive.atr(*(p[x].to_numpy(dtype=float) for x in ("high", "low", "close")), period)}
    got = recursive.scanned(df, ["high", "low", "close"], make, ["_atr"], recursive.WARM * period, cols)
    return with_features(got, {"volatility": arrays.quantile_regime(Rolling.of_blocks(), F.col("_atr"), window)}, window, keep=cols)


def by_structure(df: DataFrame, window: int = 100) -> DataFrame:
    return arrays.hurst(df, window).drop("hurst")


DETECTORS = {"volatility": by_range, "trend": trend_by_strength, "structure": by_structure}


def advanced(df: DataFrame, detectors: tuple[str, ...] = tuple(DETECTORS), separator: str = "_") -> DataFrame:
    """df with {detector}_regime of the bar before, and regime, those that are known joined."""
    out = df
    for d in detectors:
        out = DETECTORS[d](out)
    r = Rolling.of_blocks()
    out = with_features(out, {f"{d}_regime": r.lag(F.col(d)) for d in detectors}, 1, keep=df.columns)
    return out.withColumn("regime", arrays.composite([f"{d}_regime" for d in detectors], separator))


def structure_flag(df: DataFrame, window: int = 100) -> DataFrame:
    """df with structure_regime: the structure of the closes up to the bar before."""
    return advanced(df, ("structure",)).drop("regime")


def add(df: DataFrame, use_advanced: bool = False, **options) -> DataFrame:
    return advanced(df, **options) if use_advanced else basic(df, **options)


def routed(df: DataFrame, column: str, models: dict[str, str], default: str) -> DataFrame:
    """df with model: that of the row's regime, the default for any other and for none."""
    known = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    return df.withColumn("model", F.coalesce(F.try_element_at(known, F.col(column)), F.lit(default)))


def routing_summary(df: DataFrame) -> DataFrame:
    """model, n and share of the routed rows."""
    from pyspark.sql import Window as W

    n = df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # a row a model
