"""Augmented Dickey-Fuller tests of long series.

The regression of a change on the level before, a constant and lagged changes needs nothing but the cross-products of these
columns.  Blocks of a series, each with the rows before it that its lags reach, sum their own; a narrow pass adds a
series' blocks up and solves: once with the most lags, for the number of lags of least AIC, and once with that number, for the statistic.

Defined cases: null and NaN values are left out and their neighbours become adjacent; series of 50 values or less, and those that are
constant, have no row; ties of AIC go to fewer lags.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import BLOCK, BLOCK_ROWS, INDEX, KEY, TIME, blocked, indexed
from ..tables import kept

LEAST = 50
# Fixed values, published: p values of the statistic with a constant (normal law of a polynomial), and critical values by powers of 1 / n.
TAU_LEAST, TAU_SPLIT, TAU_MOST = -18.83, -1.61, 2.74
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {"critical_1": (-3.43035, -6.5393, -16.786, -79.433), "critical_5": (-2.86154, -2.8903, -4.234, -40.040), "critical_10": (-2.56677, -1.5384, -2.809, 0.0)}


def p_value(tau: float) -> float:
    if tau > TAU_MOST or tau < TAU_LEAST:
        return float(tau > TAU_MOST)
    z = sum(c * tau**i for i, c in enumerate(P_SMALL if tau <= TAU_SPLIT else P_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def most_lags(n: int) -> int:
    return max(min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2), 0)


def design(y: np.ndarray, first: int, lags: int) -> np.ndarray:
    """A row for each value from place `first` (at least lags + 1) on: its change, the level before, 1, and the changes 1 to `lags` rows earlier."""
    d = np.diff(y)
    at = np.arange(first, len(y))
    return np.column_stack([d[at - 1], y[at - 1], np.ones(len(at)), *[d[at - 1 - k] for k in range(1, lags + 1)]])


def solved(s: np.ndarray, lags: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, sum of squared residuals, inverse) of the first `lags` lags from cross-products."""
    a, b = s[1 : 3 + lags, 1 : 3 + lags], s[1 : 3 + lags, 0]
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a * scale[:, None] * scale[None, :], hermitian=True) * scale[:, None] * scale[None, :]
    beta = inverse @ b
    return beta, max(float(s[0, 0] - 2 * beta @ b + beta @ a @ beta), 0.0), inverse


def best_lags(s: np.ndarray, n: int, most: int) -> int:
    """Of least AIC, all on the same rows."""
    aic = [n * (math.log(2 * math.pi) + math.log(max(solved(s, k)[1], 1e-300) / n) + 1) + 2 * (k + 2) for k in range(most + 1)]
    return int(np.argmin(aic))


def dickey_fuller(df: DataFrame, columns: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """symbol, name, statistic, p_value, lags, n (rows of the regression), the critical values, and stationary (p below 0.05)."""
    kind = dict(df.dtypes)[KEY]
    long = df.select(KEY, TIME, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("y")) for c in columns])).alias("s")).select(KEY, TIME, "s.*")
    long = long.where(F.col("y").isNotNull() & ~F.isnan("y")).withColumn("series", F.struct(KEY, "name"))
    placed = kept(indexed(long.select("series", TIME, "y"), "series"), "series")
    sizes = placed.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    sizes = kept(sizes.where((F.col("n") > LEAST) & (F.col("_lo") < F.col("_hi"))).select(F.col("series").alias("_s"), "n", "mean"), "sizes")
    top = sizes.agg(F.max("n")).first()[0]
    result = f"{KEY} {kind}, name string, statistic double, p_value double, lags int, n long, {', '.join(f'{c} double' for c in CRITICAL)}, stationary boolean"
    if top is None:
        return df.sparkSession.createDataFrame([], result)
    base = blocked(placed, most_lags(top) + 1, rows=rows).join(sizes, F.col("series") == F.col("_s"))
    base = kept(base.select(F.col("series")[KEY].alias(KEY), "series.name", INDEX, BLOCK, "_core", "n", "mean", "y"), "blocks")

    def crossed(p: pd.DataFrame, lags: int) -> pd.DataFrame:
        p = p.sort_values(INDEX)
        at, y = p[INDEX].to_numpy(), p["y"].to_numpy() - p["mean"].iloc[0]
        own = np.flatnonzero(p["_core"].to_numpy())  # none in a block that only looks back
        first = max(int(own[0]), lags + 1) if len(own) else len(y)
        z = design(y, first, lags) if first < len(y) else np.zeros((0, lags + 3))
        return pd.DataFrame({KEY: [p[KEY].iloc[0]], "name": [p["name"].iloc[0]], "n": [p["n"].iloc[0]], "rows": [len(z)], "s": [(z.T @ z).ravel().tolist()]})

    def total(p: pd.DataFrame) -> tuple[np.ndarray, int]:
        s = np.sum(p["s"].tolist(), axis=0)
        side = math.isqrt(len(s))
        return s.reshape(side, side), int(p["rows"].sum())

    def chosen(p: pd.DataFrame) -> pd.DataFrame:
        s, n = total(p)
        return pd.DataFrame({"_k": [p[KEY].iloc[0]], "_name": [p["name"].iloc[0]], "lags": [best_lags(s, n, len(s) - 3)]})

    def tested(p: pd.DataFrame) -> pd.DataFrame:
        s, n = total(p)
        lags = len(s) - 3
        beta, ssr, inverse = solved(s, lags)
        spread = math.sqrt(max(ssr / (n - lags - 2) * inverse[0, 0], 0.0))
        tau = float(beta[0] / spread) if spread else math.copysign(math.inf, beta[0])
        value = p_value(tau)
        critical = {c: sum(b / n**i for i, b in enumerate(bs)) for c, bs in CRITICAL.items()}
        return pd.DataFrame({KEY: [p[KEY].iloc[0]], "name": [p["name"].iloc[0]], "statistic": [tau], "p_value": [value], "lags": [lags], "n": [n], **{c: [v] for c, v in critical.items()}, "stationary": [value < 0.05]})

    sums = f"{KEY} {kind}, name string, n long, rows long, s array<double>"
    first = base.groupBy(KEY, "name", BLOCK).applyInPandas(lambda p: crossed(p, most_lags(int(p["n"].iloc[0]))), sums)
    lags = kept(first.groupBy(KEY, "name").applyInPandas(chosen, f"_k {kind}, _name string, lags int"), "lags")
    again = base.join(lags, F.col(KEY).eqNullSafe(F.col("_k")) & (F.col("name") == F.col("_name"))).drop("_k", "_name")
    second = again.groupBy(KEY, "name", BLOCK).applyInPandas(lambda p: crossed(p, int(p["lags"].iloc[0])), sums)
    return second.groupBy(KEY, "name").applyInPandas(tested, result)
