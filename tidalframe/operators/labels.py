"""Forward labels: barrier scans, returns, quality and weights.

A scan looks at the next max_bars rows as one array of its frame, so a row holds
max_bars pairs at most; everything runs in blocks (see series).  INVALID marks rows whose
future is not whole or not decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..quantiles import quantiles, renamed, same, with_quantiles
from ..series import INDEX, KEY, TIME, Rolling, with_features

INVALID = -99


def _future(r: Rolling, n: int) -> Column:
    return F.collect_list(F.struct("high", "low", "open")).over(r.order.rowsBetween(1, n))


def _first(bars: Column, hit) -> Column:
    """The number (from 1) of the first bar that hits, or null."""
    return F.get(F.filter(F.transform(bars, lambda x, i: F.when(hit(x), i + 1)), lambda i: i.isNotNull()), F.lit(0))


def with_future(df: DataFrame, n: int) -> DataFrame:
    """df with _fut (the next n bars), _i and _n (place and rows of the symbol)."""
    f = with_features(df, {"_fut": _future(Rolling.of_blocks(), n), "_i": F.col(INDEX)}, 0, n)
    return f.join(df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")), KEY)


def _tail(df: DataFrame) -> DataFrame:
    """df (indexed) with _left: rows of the symbol after this one."""
    n = df.groupBy(KEY).agg(F.max(INDEX).alias("_last"))
    return df.join(n, KEY).withColumn("_left", F.col("_last") - F.col(INDEX)).drop("_last")


def _scan(df: DataFrame, upper: Column, lower: Column, valid: Column, max_bars: int, horizon: int, tie: str, excursion: tuple[str, str], bars: Column | None = None) -> DataFrame:
    """label, bars_to_hit, the two excursions and touch_type of a barrier scan.

    tie: "invalid" labels a bar that hits both barriers INVALID, "distance" takes the
    barrier nearer to its open (the upper one if equal).  bars: a row's own limit.
    """
    r = Rolling.of_blocks()
    keep = df.columns
    f = with_features(df.withColumns({"_up": upper, "_dn": lower, "_ok": F.coalesce(valid, F.lit(False)), "_mb": bars if bars is not None else F.lit(max_bars)}), {"_fut": _future(r, max_bars), "_i": F.col(INDEX)}, 0, max_bars)
    last = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    return judged(f.join(last, KEY), keep, F.lit(max_bars), horizon, tie, excursion)


def judged(f: DataFrame, keep: list[str], last_bars: Column, horizon: int, tie: str, excursion: tuple[str, str]) -> DataFrame:
    """The columns of a scan, from rows with _up, _dn (barriers), _ok, _mb (limit), _fut (bars ahead), _i and _n (place and rows of the symbol); the last last_bars rows are INVALID."""
    f = f.withColumn("_fut", F.slice("_fut", F.lit(1), F.col("_mb")))
    c = F.col
    f = f.withColumns({"_u": _first(c("_fut"), lambda x: x["high"] >= c("_up")), "_d": _first(c("_fut"), lambda x: x["low"] <= c("_dn"))})
    both = c("_u") == c("_d")
    at_open = F.get(c("_fut"), c("_u") - 1)["open"]
    nearer = F.when(F.abs(at_open - c("_up")) <= F.abs(at_open - c("_dn")), 1).otherwise(-1)
    hit = F.when(both, F.lit(INVALID) if tie == "invalid" else nearer).when(c("_d").isNull() | (c("_u") < c("_d")), F.when(c("_u").isNotNull(), 1)).otherwise(-1)
    tail = (c("_n") - 1 - c("_i")) < last_bars
    label = F.when(tail, INVALID).when(~c("_ok"), 0).otherwise(F.coalesce(hit, F.lit(0)))
    n_hit = F.when(c("_ok"), F.least("_u", "_d"))
    bars_to = F.when(tail, 0).otherwise(F.coalesce(n_hit, c("_mb")))
    seen = F.slice("_fut", F.lit(1), bars_to)
    low, high = F.array_min(F.transform(seen, lambda x: x["low"])), F.array_max(F.transform(seen, lambda x: x["high"]))
    live = ~tail & c("_ok")
    mae = F.when(live, F.least((low - c("close")) / F.nullif("close", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    mfe = F.when(live, F.greatest((high - c("close")) / F.nullif("close", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    touch = F.when(live, F.when(both, 0).when(c("_u") == n_hit, 1).when(c("_d") == n_hit, -1)).otherwise(0)
    h = horizon
    return f.select(
        *keep, label.cast("int").alias(f"label_h{h}"), bars_to.cast("int").alias(f"bars_to_hit_h{h}"),
        mae.alias(f"{excursion[0]}_h{h}"), mfe.alias(f"{excursion[1]}_h{h}"), F.coalesce(touch, F.lit(0)).cast("int").alias(f"touch_type_h{h}"),
    )


def triple_barrier(df: DataFrame, horizon: int, k_up: float, k_down: float, max_bars: int, atr: str = "atr_14", cost_ticks: float = 0.0, tick: float = 0.25) -> DataFrame:
    """Barriers k ATRs from the close; a bar that hits both is INVALID, and so are the last max_bars rows.

    With a cost, the upper barrier moves by cost_ticks * tick over the symbol's median ATR.
    """
    up: Column = F.lit(k_up)
    if cost_ticks:
        df = with_quantiles(df, [KEY], atr, [0.5], "_median", only=F.col(atr) > 0, stored=True)
        up = up + F.coalesce(F.lit(cost_ticks * tick) / F.col("_median")[0], F.lit(0.0))
    a = F.col(atr)
    out = _scan(df, F.col("close") + up * a, F.col("close") - a * k_down, a > 0, max_bars, horizon, "invalid", ("mae", "mfe"))
    return out.drop("_median")


def adaptive_barrier(df: DataFrame, horizon: int, k_up: str, k_down: str, bars: str, max_bars: int, atr: str = "atr_14") -> DataFrame:
    """A row's own multiples and limit (columns, limits of at most max_bars); a bar that hits both goes to the nearer barrier."""
    a = F.col(atr)
    return _scan(df, F.col("close") + F.col(k_up) * a, F.col("close") - F.col(k_down) * a, a > 0, max_bars, horizon, "distance", ("mae", "mfe"), F.col(bars))


def threshold(df: DataFrame, horizon: int, pct_up: float, pct_down: float, max_bars: int) -> DataFrame:
    c = F.col("close")
    return _scan(df, c * (1 + pct_up), c * (1 - pct_down), c > 0, max_bars, horizon, "distance", ("max_loss", "max_gain"))


def _ahead(h: int) -> Column:
    return Rolling.of_blocks().lead(F.col("close"), h) / F.nullif("close", F.lit(0.0))


def directional(df: DataFrame, horizon: int, threshold: float = 0.0, log: bool = False) -> DataFrame:
    q = _ahead(horizon)
    ret = F.when(q > 0, F.ln(q)) if log else q - 1
    label = F.when(ret.isNull(), INVALID).when(ret > threshold, 1).when(ret < -threshold, -1).otherwise(0)
    return with_features(df, {f"label_h{horizon}": label.cast("int"), f"fwd_return_h{horizon}": ret}, 0, horizon)


def regression(df: DataFrame, horizon: int, winsorise: tuple[float, float] = (0.01, 0.99), scale: float = 1.0, log: bool = False) -> DataFrame:
    """Forward returns between two percentiles of their symbol, scaled; null in the tail."""
    q = _ahead(horizon)
    f = with_features(df, {"_r": F.when(q > 0, F.ln(q)) if log else q - 1}, 0, horizon)
    f = with_quantiles(f, [KEY], "_r", list(winsorise), "_p", stored=True)
    t = F.when(F.col("_r").isNotNull(), F.greatest(F.least("_r", F.col("_p")[1]), F.col("_p")[0]) * scale)
    return f.withColumns({f"target_h{horizon}": t, f"label_h{horizon}": F.when(t.isNull(), INVALID).otherwise(0)}).drop("_r", "_p")


def regression_metrics(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    n = F.count(c)
    s = df.groupBy(KEY).agg(n.alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), (F.count_if(c > 0) * 100.0 / n).alias("positive_pct"))
    q = quantiles(df, [KEY], column, [0.05, 0.25, 0.5, 0.75, 0.95])
    return s.join(renamed(q, [KEY]), same([KEY]), "left").select(*s.columns, *[F.col("q")[i].alias(x) for i, x in enumerate(("p5", "p25", "median", "p75", "p95"))])


def meta(df: DataFrame, horizon: int, signal: str, fixed_bet: float | None = None) -> DataFrame:
    """Whether a primary signal was right, the signed margin and the size of the bet."""
    s = F.col(signal)
    ret = _ahead(horizon) - 1
    margin = ret * F.signum(s.cast("double"))
    label = F.when(s.isNull() | (s == 0) | ret.isNull(), INVALID).when(margin > 0, 1).otherwise(0)
    bet = F.lit(fixed_bet) if fixed_bet is not None else F.abs(margin)
    ok = label != INVALID
    return with_features(df, {f"meta_label_h{horizon}": label.cast("int"), f"margin_h{horizon}": F.when(ok, margin), f"bet_size_h{horizon}": F.when(ok, bet)}, 0, horizon)


def label_metrics(df: DataFrame, horizon: int) -> DataFrame:
    lab, bars = F.col(f"label_h{horizon}"), F.col(f"bars_to_hit_h{horizon}")
    ok = lab != INVALID
    n = F.count_if(ok)
    out = [n.alias("n_valid"), F.count_if(~ok).alias("n_invalid")]
    for name, v in (("short", -1), ("neutral", 0), ("long", 1)):
        out += [F.count_if(lab == v).alias(f"n_{name}"), (F.count_if(lab == v) * 100.0 / F.nullif(n, F.lit(0))).alias(f"pct_{name}")]
    avg = lambda c: F.avg(F.when(ok, F.col(f"{c}_h{horizon}")))
    return df.groupBy(KEY).agg(*out, avg("mae").alias("avg_mae"), avg("mfe").alias("avg_mfe"), (avg("mfe") / F.nullif(F.abs(avg("mae")), F.lit(0.0))).alias("mfe_mae_ratio"), F.avg(F.when(ok & (bars > 0), bars)).alias("avg_bars"))


#: Weights of speed, adverse and favourable excursion, pain-to-gain and drawdown.
QUALITY = (0.20, 0.25, 0.20, 0.20, 0.15)


def quality(df: DataFrame, horizon: int, ideal_speed: float | None = None) -> DataFrame:
    """quality in [0, 1]: a gaussian of the bars to the hit, excursions against their 95th percentiles, their ratio and the drawdown a bar."""
    h = horizon
    lab, bars, mae, mfe = (F.col(f"{c}_h{h}") for c in ("label", "bars_to_hit", "mae", "mfe"))
    risk = F.when(lab == 1, F.abs(mae)).when(lab == -1, F.abs(mfe)).otherwise(F.abs(mae))
    gain = F.when(lab == 1, F.abs(mfe)).when(lab == -1, F.abs(mae)).otherwise(F.abs(mfe))
    x = df.withColumns({"_risk": risk, "_gain": gain, f"pain_to_gain_h{h}": risk / F.nullif(gain, F.lit(0.0)), f"time_weighted_dd_h{h}": risk * F.sqrt(bars.cast("double"))})
    names = ("_risk", "_gain", f"pain_to_gain_h{h}", f"time_weighted_dd_h{h}")
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(names)]))
    long = x.where(lab != INVALID).select(KEY, four.alias("_e")).select(KEY, "_e.i", "_e.x").where("x > 0")
    p95 = quantiles(long, [KEY, "i"], "x", [0.95], stored=True).groupBy(KEY).agg(*[F.max(F.when(F.col("i") == i, F.col("q")[0])).alias(f"_p{i}") for i in range(len(names))])
    x = x.join(renamed(p95, [KEY]), same([KEY]), "left").drop(f"_of_{KEY}")
    ideal = ideal_speed if ideal_speed is not None else 1.5 * h
    unit = lambda c, i: F.least(F.col(c) / F.nullif(f"_p{i}", F.lit(0.0)), F.lit(1.0))
    parts = [F.exp(-F.pow((bars - ideal) / ideal, 2) / 2), 1 - F.coalesce(unit(names[0], 0), F.lit(0.0)), F.coalesce(unit(names[1], 1), F.lit(0.0)), 1 - F.coalesce(unit(names[2], 2), F.lit(1.0)), 1 - F.coalesce(unit(names[3], 3), F.lit(0.0))]
    q = F.lit(0.0)
    for w, part in zip(QUALITY, parts, strict=True):
        q = q + part * w
    return x.withColumn(f"quality_h{h}", q).drop("_risk", "_gain", "_p0", "_p1", "_p2", "_p3")


def weights(df: DataFrame, horizon: int) -> DataFrame:
    """sample_weight: 1.5 from the 80th percentile of quality, 1 from the 20th, else 0.5; ties by value."""
    q = f"quality_h{horizon}"
    x = with_quantiles(df, [KEY], q, [0.2, 0.8], "_p", stored=True)
    w = F.when(F.col(q) >= F.col("_p")[1], 1.5).when(F.col(q) >= F.col("_p")[0], 1.0).otherwise(0.5)
    return x.withColumn(f"sample_weight_h{horizon}", w).drop("_p")


def forward_returns(df: DataFrame, horizon: int) -> DataFrame:
    q = F.when((_ahead(horizon) > 0), _ahead(horizon))
    return with_features(df, {f"fwd_return_h{horizon}": q - 1, f"fwd_return_log_h{horizon}": F.ln(q)}, 0, horizon)


def end_times(df: DataFrame, horizon: int, max_bars: int) -> DataFrame:
    """label_end_time: the time of the bar that decides, or of the last one."""
    r = Rolling.of_blocks()
    times = F.collect_list(F.col(TIME)).over(r.order.rowsBetween(0, max_bars))
    f = with_features(df, {"_t": times}, 0, max_bars)
    at = F.least(F.col(f"bars_to_hit_h{horizon}"), F.size("_t") - 1)
    return f.withColumn(f"label_end_time_h{horizon}", F.get("_t", at)).drop("_t")


def final_labels(df: DataFrame, horizon: int, k_up: float, k_down: float, max_bars: int, atr: str = "atr_14") -> DataFrame:
    out = forward_returns(weights(quality(triple_barrier(df, horizon, k_up, k_down, max_bars, atr), horizon), horizon), horizon)
    return end_times(out, horizon, max_bars)


STRATEGIES = {"triple_barrier": triple_barrier, "adaptive": adaptive_barrier, "threshold": threshold, "directional": directional, "regression": regression, "meta": meta}


def register(name: str, f) -> None:
    STRATEGIES[name] = f


def report(df: DataFrame, horizons: list[int]) -> DataFrame:
    """symbol, horizon, label, n, pct over all rows."""
    rows = df.select(KEY, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"label_h{h}").cast("int").alias("label")) for h in horizons])).alias("x")).select(KEY, "x.*")
    n = rows.groupBy(KEY, "horizon", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(KEY, "horizon"))
    return n.withColumn("pct", F.col("n") * 100.0 / total)
