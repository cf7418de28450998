"""Search for barrier parameters: a score of a labelling from one aggregate, over candidates in one pass each."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups
from ..series import INDEX, KEY, indexed
from ..tables import kept
from . import labels

# The least and most shares of labels, and the range of neutral ones aimed at.
LEAST_SHARE = 0.05
LEAST_CLASS = 0.10
NEUTRAL_LEAST, NEUTRAL_LOW, NEUTRAL_HIGH, NEUTRAL_MOST = 0.10, 0.20, 0.30, 0.40
SHORT_LEAST, SHORT_MOST = 0.10, 0.90
REJECTED = -10_000.0
# What a search may choose.
K_RANGE, BARS_RANGE = (0.8, 2.5), (2.0, 3.0)


def shares(df: DataFrame, horizon: int, atr: str = "atr_14", by: tuple[str, ...] = ()) -> DataFrame:
    """One row a symbol (and values of by): shares of labels, mean bars to a hit, profit and risk by excursions, trades, mean ATR."""
    lab, bars, mae, mfe = (F.col(f"{c}_h{horizon}") for c in ("label", "bars_to_hit", "mae", "mfe"))
    n = F.count(F.lit(1))
    toward = F.when(lab == 1, mfe).when(lab == -1, F.abs(mae)).otherwise(0.0)
    against = F.when(lab == 1, F.abs(mae)).when(lab == -1, mfe).otherwise(0.0)
    return df.groupBy(KEY, *by).agg(
        (F.count_if(lab == 1) / n).alias("long"), (F.count_if(lab == -1) / n).alias("short"), (F.count_if(lab == 0) / n).alias("neutral"),
        F.avg(F.when(lab != 0, bars)).alias("bars"), F.sum(toward).alias("profit"), F.sum(against).alias("risk"), F.count_if(lab.isin(1, -1)).alias("trades"), F.avg(atr).alias("atr"),
    )


def _between(x: Column, lo: float, hi: float) -> Column:
    return (x >= lo) & (x <= hi)


def score(of: DataFrame, horizon: int, regime: str = "low_vol") -> DataFrame:
    """shares() with score: REJECTED and a small slope outside the hard limits, else the sum of its parts."""
    c = F.col
    signals = c("long") + c("short")
    longs, shorts = (c(k) / F.nullif(signals, F.lit(0.0)) for k in ("long", "short"))
    neutral, lowest = c("neutral"), F.least("long", "short")
    slope = (
        F.when(neutral < NEUTRAL_LEAST, neutral)
        .when(neutral > NEUTRAL_MOST, 1 - neutral)
        .when(lowest < LEAST_SHARE, signals)
        .when(lowest < LEAST_CLASS, lowest)
        .when(~_between(shorts, SHORT_LEAST, SHORT_MOST), 1 - F.abs(shorts - 0.5))
    )
    under, over = F.greatest(F.lit(NEUTRAL_LOW) - neutral, F.lit(0.0)), F.greatest(neutral - NEUTRAL_HIGH, F.lit(0.0))
    aim = F.lit(10.0) - under * 40 - over * 20 - F.greatest(F.lit(0.15) - neutral, F.lit(0.0)) * 50
    balance = F.coalesce(F.lit(2.0) - F.abs(longs - 0.5) * 8 - F.when(_between(longs, 0.30, 0.70), 0.0).otherwise(3.0), F.lit(-10.0))
    speed = F.coalesce(F.greatest(F.least(1 - c("bars") / (horizon * 2.0), F.lit(1.5)), F.lit(-2.0)), F.lit(-2.0))
    factor = c("profit") / F.nullif("risk", F.lit(0.0))
    gain = F.when(factor > 2, 1.5).when(factor >= 1, 2.0).when(factor >= 0.8, 0.5).when(factor.isNotNull(), -2.0).otherwise(0.0)
    cost = lookups.trade_cost(c(KEY), F.lit(regime)) * lookups.tick_value(c(KEY))
    ratio = cost / (c("profit") / F.nullif("trades", F.lit(0)) * c("atr") + 1e-6)
    trading = F.when(F.coalesce(c("atr"), F.lit(0.0)) <= 0, 0.0).when(ratio > 0.20, F.greatest((ratio - 0.20) * -10, F.lit(-10.0))).when(ratio.isNotNull(), 0.5).otherwise(0.0)
    least = F.least("long", "short", "neutral")
    classes = F.when(least < 0.15, (F.lit(0.15) - least) * -30).otherwise(0.5)
    return of.withColumn("score", F.when(slope.isNotNull(), slope * 10 + REJECTED).otherwise(aim + balance + speed + gain + trading + classes))


def candidates(n: int, seed: int = 42) -> list[tuple[float, float, float]]:
    """n seeded choices of (upper multiple, lower multiple, bars a horizon)."""
    rng = random.Random(seed)
    return [(round(rng.uniform(*K_RANGE), 3), round(rng.uniform(*K_RANGE), 3), round(rng.uniform(*BARS_RANGE), 2)) for _ in range(n)]


def subset(df: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """A contiguous stretch of each symbol that starts at the same seeded share of it."""
    at = random.Random(seed).uniform(0, 1 - share)
    n = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    i = indexed(df).join(n, KEY)
    return i.where((F.col(INDEX) >= F.floor(F.col("_n") * at)) & (F.col(INDEX) < F.floor(F.col("_n") * at) + F.floor(F.col("_n") * share))).drop("_n", INDEX)


def search(df: DataFrame, horizon: int, trials: int = 20, share: float = 0.3, seed: int = 42, train: float | None = None, atr: str = "atr_14") -> DataFrame:
    """symbol, k_up, k_down, max_bars, score of every candidate; train keeps the search off what follows that share of rows.

    All candidates are scored from one scan: a small table of them is broadcast to the rows, each with its bars ahead.
    """
    if train is not None:
        n = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
        df = indexed(df).join(n, KEY).where(F.col(INDEX) < F.floor(F.col("_n") * train)).drop("_n", INDEX)
    part = kept(subset(df, share, seed), "search")
    tried = [(i, up, down, max(1, int(horizon * mult))) for i, (up, down, mult) in enumerate(candidates(trials, seed))]
    table = df.sparkSession.createDataFrame(tried, "trial int, k_up double, k_down double, max_bars int")
    f = kept(labels.with_future(part, max((t[3] for t in tried), default=1)), "search-bars")
    c, a = F.col, F.col(atr)
    f = f.select(KEY, "close", atr, "_fut", "_i", "_n").crossJoin(F.broadcast(table))
    f = f.withColumns({"_up": c("close") + c("k_up") * a, "_dn": c("close") - a * c("k_down"), "_ok": F.coalesce(a > 0, F.lit(False)), "_mb": c("max_bars")})
    by = ("trial", "k_up", "k_down", "max_bars")
    labelled = labels.judged(f, [KEY, atr, *by], c("max_bars"), horizon, "invalid", ("mae", "mfe"))
    return score(shares(labelled, horizon, atr, by), horizon).select(KEY, "k_up", "k_down", "max_bars", "score")


def best(found: DataFrame) -> DataFrame:
    return found.groupBy(KEY).agg(F.max_by(F.struct("k_up", "k_down", "max_bars", "score"), F.struct("score", -F.col("k_up"), -F.col("k_down"))).alias("b")).select(KEY, "b.*")


#: Of an adaptive search: trials a pass, the share of trials that counts as good, and the draws that each new trial is the best of.
BATCH, GOOD, DRAWS = 20, 0.25, 24
_BOUNDS = (K_RANGE, K_RANGE, BARS_RANGE)
TRIALS = "trial int, k_up double, k_down double, mult double"


def _density(x: np.ndarray, seen: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """A mixture of a normal curve about each value seen and of a flat one over the range."""
    width = max((hi - lo) / max(len(seen), 1) ** 0.5 / 2, (hi - lo) / 50)
    curves = np.exp(-0.5 * ((x[:, None] - seen[None, :]) / width) ** 2) / (width * np.sqrt(2 * np.pi))
    return (curves.sum(axis=1) + 1 / (hi - lo)) / (len(seen) + 1)


def proposed(tried: np.ndarray, scores: np.ndarray, n: int, rng: np.random.Generator, good: float = GOOD, draws: int = DRAWS) -> np.ndarray:
    """n new points (n, 3): each the best of some draws about the good trials, by how much denser the good ones are there than the rest.

    Without trials the points are uniform.  Ties of scores go to the earlier trial.
    """
    low, high = (np.array(b) for b in zip(*_BOUNDS, strict=True))
    if not len(tried):
        return rng.uniform(low, high, (n, 3))
    order = np.argsort(-scores, kind="stable")
    k = max(1, int(np.ceil(good * len(order))))
    best, rest = tried[order[:k]], tried[order[k:]]
    width = np.maximum((high - low) / np.sqrt(k) / 2, (high - low) / 50)
    about = best[rng.integers(0, k, n * draws)] + width * rng.normal(size=(n * draws, 3))
    flat = rng.random(n * draws) < 1 / (k + 1)
    points = np.where(flat[:, None] | (about < low) | (about > high), rng.uniform(low, high, about.shape), about)
    ratio = sum(np.log(_density(points[:, j], best[:, j], *_BOUNDS[j])) - np.log(_density(points[:, j], rest[:, j], *_BOUNDS[j])) for j in range(3))
    pick = ratio.reshape(n, draws).argmax(axis=1) + draws * np.arange(n)
    return points[pick]


def adaptive(df: DataFrame, horizon: int, trials: int = 100, share: float = 0.3, seed: int = 42, train: float | None = None, atr: str = "atr_14", batch: int = BATCH) -> DataFrame:
    """symbol, batch, trial, k_up, k_down, mult, max_bars, score: trials drawn batch by batch from the best of those before, each symbol for itself.

    A batch is one pass over the rows, joined with its symbol's trials; new trials are drawn in tasks, a symbol's history (a row a trial) at a time.
    The same seed gives the same trials whatever the partitions.
    """
    if train is not None:
        n = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
        df = indexed(df).join(n, KEY).where(F.col(INDEX) < F.floor(F.col("_n") * train)).drop("_n", INDEX)
    part = kept(subset(df, share, seed), "search")
    longest = max(1, int(horizon * BARS_RANGE[1]))
    f = kept(labels.with_future(part, longest).select(KEY, "close", atr, "_fut", "_i", "_n"), "search-bars")
    kind = dict(df.dtypes)[KEY]
    symbols = kept(part.select(KEY).distinct(), "symbols")
    columns = f"{KEY} {kind}, batch int, {TRIALS}, max_bars int, score double"

    def drawn(b: int, n: int):
        def draw(key: tuple, old: pd.DataFrame) -> pd.DataFrame:
            old = old[old["trial"].notna()].sort_values("trial")
            rng = np.random.default_rng([seed, b, zlib.crc32(str(key[0]).encode())])
            x = np.round(proposed(old[["k_up", "k_down", "mult"]].to_numpy(dtype=float), old["score"].to_numpy(dtype=float), n, rng), 3)
            return pd.DataFrame({KEY: key[0], "batch": b, "trial": b * batch + np.arange(n), "k_up": x[:, 0], "k_down": x[:, 1], "mult": x[:, 2]})

        return draw

    history = None
    for b in range(-(-trials // batch)):
        n = min(batch, trials - b * batch)

        known = symbols.join(history, KEY, "left") if history is not None else symbols.withColumns({"trial": F.lit(None).cast("int"), **{c: F.lit(None).cast("double") for c in ("k_up", "k_down", "mult", "score")}})
        todo = known.groupBy(KEY).applyInPandas(drawn(b, n), f"{KEY} {kind}, batch int, {TRIALS}")
        todo = kept(todo.withColumn("max_bars", F.greatest(F.lit(1), (F.lit(horizon) * F.col("mult")).cast("int"))), "trials")
        c, a = F.col, F.col(atr)
        rows = f.join(todo.select(KEY, "trial", "k_up", "k_down", "max_bars"), KEY)
        rows = rows.withColumns({"_up": c("close") + c("k_up") * a, "_dn": c("close") - a * c("k_down"), "_ok": F.coalesce(a > 0, F.lit(False)), "_mb": c("max_bars")})
        by = ("trial", "k_up", "k_down", "max_bars")
        labelled = labels.judged(rows, [KEY, atr, *by], c("max_bars"), horizon, "invalid", ("mae", "mfe"))
        scored = score(shares(labelled, horizon, atr, by), horizon).select(KEY, "trial", "score")
        got = todo.join(scored, [KEY, "trial"], "left").select(*[x.split()[0] for x in columns.split(", ")])
        got = got.withColumn("score", F.coalesce("score", F.lit(REJECTED * 1.0)))
        history = kept(got if history is None else history.unionByName(got), "history")
    return history if history is not None else df.sparkSession.createDataFrame([], columns)


def convergence(history: DataFrame) -> DataFrame:
    """symbol, batch, trials, best, mean, gain: after each batch the best score so far, the batch's mean, and what the batch gained."""
    from pyspark.sql import Window as W

    each = history.groupBy(KEY, "batch").agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("_best"), F.avg("score").alias("mean"))
    order = W.partitionBy(KEY).orderBy("batch")  # a row a batch
    best = F.max("_best").over(order)
    each = each.withColumns({"trials": F.sum("_n").over(order), "best": best}).withColumn("gain", F.coalesce(F.col("best") - F.lag("best").over(order), F.lit(0.0)))
    return each.select(KEY, "batch", "trials", "best", "mean", "gain")
