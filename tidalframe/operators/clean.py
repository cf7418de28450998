"""Cleaning of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..quantiles import with_quantiles
from ..series import KEY, TIME, Rolling, indexed, with_features
from .resample import resample

#: Other names of the standard columns.
ALIASES = {"timestamp": TIME, "time": TIME, "date": TIME, "dt": TIME, "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "trade_volume": "volume"}
PRICES = ["open", "high", "low", "close"]
ROLL = 0.10


def standardise(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    names = [(aliases or ALIASES).get(n := c.strip().lower(), n) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"two columns would be called the same: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def coerce(df: DataFrame) -> DataFrame:
    """Times and prices by try_cast (rows without a whole price go), volume as a whole number with 0 for missing."""
    num = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    vol = F.coalesce(num("volume").try_cast("long"), F.lit(0).cast("long"))
    out = df.withColumns({TIME: F.col(TIME).try_cast("timestamp_ntz"), **{p: num(p) for p in PRICES}, "volume": vol})
    return out.na.drop("any", subset=PRICES)


def to_utc(df: DataFrame, zone: str = "UTC") -> DataFrame:
    return df.withColumn(TIME, F.to_utc_timestamp(F.col(TIME).cast("timestamp"), zone).cast("timestamp_ntz"))


def _steps() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in PRICES)
    return {"inverted": h < low, "high_open": F.greatest(h, low) < o, "high_close": F.greatest(h, low, o) < c, "low_open": F.least(h, low) > o, "low_close": F.least(h, low, o) > c, "not_positive": (o <= 0) | (F.greatest(h, low, o, c) <= 0) | (F.least(h, low, o, c) <= 0) | (c <= 0), "negative_volume": F.col("volume") < 0}


def repair(df: DataFrame) -> DataFrame:
    """Highs and lows in order and around open and close; rows with a price at or below 0 go; negative volumes are 0."""
    o, h, low, c = (F.col(x) for x in PRICES)
    fixed = df.withColumns({"high": F.greatest(h, low, o, c), "low": F.least(h, low, o, c), "volume": F.when(F.col("volume") < 0, 0).otherwise(F.col("volume")).cast(dict(df.dtypes)["volume"])})
    return fixed.where("open > 0 and high > 0 and low > 0 and close > 0")


def repair_report(df: DataFrame) -> DataFrame:
    """One row: how many rows each step of repair() changes or drops."""
    steps = _steps()
    kept = ~F.coalesce(steps["not_positive"], F.lit(False))
    return df.agg(*[F.count_if(x & kept if n == "negative_volume" else x).alias(n) for n, x in steps.items()])


def dedupe(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each symbol and time in the given order."""
    w = W.partitionBy(KEY, TIME).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_report(df: DataFrame) -> DataFrame:
    n = df.groupBy(KEY, TIME).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(KEY).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), (F.sum(F.col("n") - 1) * 100.0 / F.sum("n")).alias("pct"))


def _neighbours(df: DataFrame, **columns: Column) -> DataFrame:
    return with_features(df, columns, 1)


def gaps(df: DataFrame, minutes: int = 1, factor: float = 2.0) -> DataFrame:
    """Where two times of a symbol are more than factor times the step apart."""
    r = Rolling.of_blocks()
    g = with_features(df.select(KEY, TIME), {"gap_start": r.lag(F.col(TIME))}, 1)
    width = (F.unix_seconds(F.col(TIME).cast("timestamp")) - F.unix_seconds(F.col("gap_start").cast("timestamp"))) / 60
    return g.select(KEY, "gap_start", F.col(TIME).alias("gap_end"), width.alias("gap_minutes")).where(F.col("gap_minutes") > minutes * factor)


def calendar_gaps(df: DataFrame, minutes: int = 1) -> DataFrame:
    """Gaps with the bars they miss and whether the market's hours explain them."""
    g = gaps(df, minutes, 1.0)
    return g.select(KEY, "gap_start", "gap_end", (F.floor(F.col("gap_minutes") / minutes) - 1).cast("long").alias("missing_bars"), clock.expected_gap("gap_start", "gap_end").alias("expected"))


def completeness(df: DataFrame, minutes: int = 1) -> DataFrame:
    g = calendar_gaps(df, minutes).groupBy(KEY).agg(F.sum("missing_bars").alias("missing"), F.sum(F.when(~F.col("expected"), F.col("missing_bars")).otherwise(0)).alias("unexpected"))
    n = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    miss = F.coalesce("unexpected", F.lit(0))
    return n.join(g, KEY, "left").select(KEY, "rows", F.coalesce("missing", F.lit(0)).alias("missing"), miss.alias("unexpected"), (F.col("rows") * 100.0 / (F.col("rows") + miss)).alias("completeness"))


def _grid(df: DataFrame, minutes: int) -> DataFrame:
    """Every step of each symbol from its first to its last time, a day at a time so that no row holds a whole range."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    ends = df.groupBy(KEY).agg(F.min(TIME).alias("_lo"), F.max(TIME).alias("_hi"))
    days = ends.withColumn("_n", F.floor((F.unix_seconds(F.col("_hi").cast("timestamp")) - F.unix_seconds(F.col("_lo").cast("timestamp"))) / 86400))
    days = days.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    per = 1440 // minutes
    if 1440 % minutes:
        raise ValueError("the step has to divide a day")
    at = F.explode(F.sequence(F.lit(0), F.lit(per - 1)))
    grid = days.withColumn("_k", at).withColumn(TIME, F.col("_lo") + (F.col("_d") * per + F.col("_k")) * step)
    return grid.where(F.col(TIME) <= F.col("_hi")).select(KEY, TIME)


def _filled(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    r = Rolling.of_blocks()
    frame = r.order.rowsBetween(-limit, 0)
    made = {f"_f_{c}": F.last(c, ignorenulls=True).over(frame) for c in columns}
    out = with_features(df, made, limit)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_simple(df: DataFrame, minutes: int = 1, limit: int = 60) -> DataFrame:
    """On the full grid, missing_bar = 1 where there was none; all columns carried forward so many steps at most; rows still missing go."""
    rest = [c for c in df.columns if c not in (KEY, TIME)]
    on = _grid(df, minutes).join(df.withColumn("_is", F.lit(1)), [KEY, TIME], "left")
    on = on.withColumn("missing_bar", F.when(F.col("_is").isNull(), 1).otherwise(0)).drop("_is")
    return _filled(on, rest, limit).na.drop("any", subset=rest)


def fill(df: DataFrame, minutes: int = 1, limit: int = 5, calendar: bool = True, method: str = "forward") -> DataFrame:
    """On the grid of open market minutes: prices carried forward or interpolated, volume 0, filled = 1; rows without a close go."""
    rest = [c for c in df.columns if c not in (KEY, TIME)]
    on = _grid(df, minutes)
    if calendar:
        on = on.where(~clock.market_closed())
    on = on.join(df.withColumn("_is", F.lit(1)), [KEY, TIME], "left").withColumn("filled", F.when(F.col("_is").isNull(), 1).otherwise(0)).drop("_is")
    prices = [c for c in rest if c != "volume"]
    if method == "interpolate":
        out = on
        for c in [c for c in prices if dict(df.dtypes)[c] in ("double", "float")]:
            out = interpolate(out, c, limit)
    else:
        out = _filled(on, prices, limit)
    return out.withColumn("volume", F.coalesce("volume", F.lit(0).cast(dict(df.dtypes)["volume"]))).where("close is not null")


def interpolate(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Linear between the values around a run of missing ones, for the first `limit` rows of the run, however long it is.

    The values around a run come from its own day, or from the nearest day before and after that has one.
    """
    c = F.col
    here = F.when(c(column).isNotNull(), F.struct(c("_idx").alias("i"), c(column).alias("x")))
    rows = indexed(df).withColumns({"_day": F.to_date(TIME), "_here": here})
    day, days = W.partitionBy(KEY, "_day").orderBy("_idx"), W.partitionBy(KEY).orderBy("_day")
    ends = rows.groupBy(KEY, "_day").agg(F.min("_here").alias("_lo"), F.max("_here").alias("_hi"))
    ends = ends.select(
        c(KEY).alias("_k"), c("_day").alias("_d"), F.last("_hi", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1)).alias("_pd"),
        F.first("_lo", ignorenulls=True).over(days.rowsBetween(1, W.unboundedFollowing)).alias("_nd"),
    )
    before = F.last("_here", ignorenulls=True).over(day.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_here", ignorenulls=True).over(day.rowsBetween(0, W.unboundedFollowing))
    made = rows.withColumns({"_p": before, "_n": after}).join(ends, c(KEY).eqNullSafe(c("_k")) & c("_day").eqNullSafe(c("_d")))
    p, n = F.coalesce("_p", "_pd"), F.coalesce("_n", "_nd")
    k = c("_idx") - p["i"]
    line = p["x"] + (n["x"] - p["x"]) * k / (n["i"] - p["i"])
    return made.withColumn(column, F.when(c(column).isNotNull(), c(column)).when(k <= limit, line)).select(*df.columns)


def zscore_outliers(df: DataFrame, column: str = "close", threshold: float = 5.0) -> DataFrame:
    """df with outlier: more than so many standard deviations from its symbol's mean."""
    s = df.groupBy(KEY).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.abs(F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return df.join(s, KEY).withColumn("outlier", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_s")


def iqr_outliers(df: DataFrame, column: str = "close", multiplier: float = 3.0) -> DataFrame:
    s = with_quantiles(df, [KEY], column, [0.25, 0.75], "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    out = (F.col(column) < lo - (hi - lo) * multiplier) | (F.col(column) > hi + (hi - lo) * multiplier)
    return s.withColumn("outlier", F.coalesce(out, F.lit(False))).drop("_q")


def atr_spikes(df: DataFrame, threshold: float = 5.0, period: int = 14) -> DataFrame:
    """outlier: a move of more than so many average ranges; before there is an average it counts as 0, so any move does."""
    from ..functions import recursive

    cols = list(df.columns)

    def make(p):
        a = recursive.atr(*(p[x].to_numpy(dtype=float) for x in ("high", "low", "close")), period)
        return {"_atr": a}

    got = recursive.scanned(df, ["high", "low", "close"], make, ["_atr"], recursive.WARM * period, cols)
    r = Rolling.of_blocks()
    out = with_features(got, {"_before": r.lag(F.col("close"))}, 1, keep=[*cols, "_atr"])
    move = F.abs(F.col("close") / F.nullif("_before", F.lit(0.0)) - 1)
    return out.withColumn("outlier", F.coalesce(move > F.coalesce("_atr", F.lit(0.0)) * threshold / F.nullif("close", F.lit(0.0)), F.lit(False))).drop("_before", "_atr")


def remove_outliers(df: DataFrame, method: str = "all") -> DataFrame:
    found = {"zscore": [zscore_outliers], "iqr": [iqr_outliers], "atr": [atr_spikes], "all": [zscore_outliers, iqr_outliers, atr_spikes]}[method]
    out = df
    for i, f in enumerate(found):
        out = f(out).withColumnRenamed("outlier", f"_out{i}")
    names = [f"_out{i}" for i in range(len(found))]
    return out.where(" and ".join(f"not {n}" for n in names)).drop(*names)


def roll_flags(df: DataFrame, threshold: float = ROLL, bars: int = 5) -> DataFrame:
    """roll_event: a move of at least the threshold; roll_window: such a move within so many bars."""
    r = Rolling.of_blocks()
    move = F.abs(F.col("close") / F.nullif(r.lag(F.col("close")), F.lit(0.0)) - 1)
    event = F.coalesce((move >= threshold).cast("int"), F.lit(0))
    return with_features(df, {"roll_event": event, "roll_window": F.max(event).over(r.order.rowsBetween(-bars, bars))}, bars + 1, bars)


def clean(df: DataFrame, minutes: int = 5, limit: int = 30) -> DataFrame:
    """The active path: repair, fill the grid, repair, resample, roll flags, session, repair."""
    base = repair(fill_simple(repair(coerce(df)), 1, limit))
    out = roll_flags(resample(base, minutes, flags=("missing_bar",)))
    return repair(out.withColumn("session_id", clock.session_id()))


def nan_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, rate of missing values of each column, in one pass."""
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    one = df.agg(*[(F.count_if(bad(c)) / F.count(F.lit(1))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("rate")) for c in columns])).alias("x")).select("x.*")


def drop_missing(df: DataFrame, threshold: float = 0.9, protected: tuple[str, ...] = (KEY, TIME, *PRICES, "volume")) -> DataFrame:
    """Without columns that miss more than the threshold, then without rows that miss anything."""
    rates = {r["name"]: r["rate"] for r in nan_audit(df, df.columns).collect()}  # a row a column
    if empty := [c for c in protected if rates.get(c) == 1]:
        raise ValueError(f"nothing in {', '.join(empty)}")
    return df.drop(*[c for c, x in rates.items() if c not in protected and (x == 1 or x > threshold)]).na.drop("any")


def schema_violations(df: DataFrame) -> DataFrame:
    """name, n of every broken rule of a bar table: order, signs, doubles, missing values."""
    o, h, low, c = (F.col(x) for x in PRICES)
    rules = {
        "missing": F.greatest(*[F.col(x).isNull() for x in (TIME, *PRICES, "volume")]),
        "not_positive": (F.least(o, h, low, c) <= 0) | (F.col("volume") <= 0),
        "high_below": h < F.greatest(o, low, c),
        "low_above": low > F.least(o, h, c),
    }
    one = df.agg(*[F.count_if(x).alias(n) for n, x in rules.items()], (F.count(F.lit(1)) - F.count_distinct(KEY, TIME)).alias("duplicate"))
    names = [*rules, "duplicate"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def valid_labels(df: DataFrame, columns: list[str], invalid: int = -99) -> DataFrame:
    return df.where(" and ".join(f"{c} <> {invalid}" for c in columns))


def label_domain(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(~F.col(c).isin(-1, 0, 1, -99)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")
