"""Fixed tables of costs, barriers, regime multipliers and market days, and expressions over them."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Round-trip commission in ticks, slippage in ticks a side, value of a tick.
COMMISSION = {"MES": 0.5, "MGC": 0.3}
COMMISSION_DEFAULT = 0.5
SLIPPAGE = {("MES", "low_vol"): 0.5, ("MES", "high_vol"): 1.0, ("MGC", "low_vol"): 0.75, ("MGC", "high_vol"): 1.5}
SLIPPAGE_DEFAULT = {"low_vol": 0.5, "high_vol": 1.0}
TICK_VALUE = {"MES": 1.25, "MGC": 1.00}
TICK_VALUE_DEFAULT = 1.00

# Symbol, horizon, upper and lower multiple of the ATR, most bars.
BARRIERS = [
    ("MES", 5, 1.50, 1.00, 12),
    ("MES", 10, 2.00, 1.40, 25),
    ("MES", 15, 2.50, 1.75, 38),
    ("MES", 20, 3.00, 2.10, 50),
    ("MGC", 5, 1.20, 1.20, 12),
    ("MGC", 10, 1.60, 1.60, 25),
    ("MGC", 15, 2.00, 2.00, 38),
    ("MGC", 20, 2.50, 2.50, 50),
]
# Fixed values for other symbols: horizon, multiples, most bars.
BARRIERS_DEFAULT = [(1, 0.30, 0.30, 4), (5, 1.35, 1.10, 12), (10, 1.80, 1.35, 25), (15, 2.25, 1.70, 38), (20, 2.75, 2.30, 50)]
# Horizon, upper and lower share of the price, most bars.
THRESHOLDS = [(1, 0.0015, 0.0015, 5), (5, 0.0030, 0.0020, 15), (20, 0.0060, 0.0042, 60)]
# Kind of regime, regime, multipliers of the upper and lower barrier and of the bars.
REGIMES = [
    ("volatility", "high", 1.2, 1.2, 1.1),
    ("volatility", "low", 0.9, 0.9, 0.9),
    ("volatility", "normal", 1.0, 1.0, 1.0),
    ("trend", "uptrend", 1.05, 0.95, 1.0),
    ("trend", "downtrend", 0.95, 1.05, 1.0),
    ("trend", "sideways", 1.0, 1.0, 0.95),
    ("structure", "trending", 1.05, 1.05, 1.1),
    ("structure", "mean_reverting", 0.95, 0.95, 0.9),
    ("structure", "random", 1.0, 1.0, 1.0),
]
#: Early closes besides the day after Thanksgiving: month and day.
EARLY = [(12, 24), (12, 31)]


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def commission(symbol: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(COMMISSION), symbol), F.lit(COMMISSION_DEFAULT))


def slippage(symbol: Column, regime: Column) -> Column:
    own = _map({f"{s}|{r}": v for (s, r), v in SLIPPAGE.items()})
    return F.coalesce(F.try_element_at(own, F.concat_ws("|", symbol, regime)), F.try_element_at(_map(SLIPPAGE_DEFAULT), regime))


def trade_cost(symbol: Column, regime: Column, with_slippage: bool = True) -> Column:
    """Ticks of a round trip."""
    return commission(symbol) + slippage(symbol, regime) * 2 if with_slippage else commission(symbol)


def tick_value(symbol: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TICK_VALUE), symbol), F.lit(TICK_VALUE_DEFAULT))


def barriers(df: DataFrame, symbol: str = "symbol", horizon: str = "horizon") -> DataFrame:
    """df with k_up, k_down, max_bars: of the symbol and horizon, else of the horizon, else by formula (1 + 1.5 h / 20, 3 h)."""
    spark = df.sparkSession
    own = F.broadcast(spark.createDataFrame(BARRIERS, "_s string, _h int, _u1 double, _d1 double, _b1 int"))
    default = F.broadcast(spark.createDataFrame(BARRIERS_DEFAULT, "_h2 int, _u2 double, _d2 double, _b2 int"))
    h = F.col(horizon)
    out = df.join(own, (F.col(symbol) == F.col("_s")) & (h == F.col("_h")), "left").join(default, h == F.col("_h2"), "left")
    k = h * 1.5 / 20 + 1.0
    made = {"k_up": F.coalesce("_u1", "_u2", k), "k_down": F.coalesce("_d1", "_d2", k), "max_bars": F.coalesce("_b1", "_b2", F.greatest(F.lit(5), h * 3).cast("int"))}
    return out.withColumns(made).drop("_s", "_h", "_u1", "_d1", "_b1", "_h2", "_u2", "_d2", "_b2")


def adjusted(df: DataFrame, volatility: str, trend: str, structure: str) -> DataFrame:
    """df (k_up, k_down, max_bars) times the multipliers of its three regimes; regimes unknown to the table multiply by 1."""
    m = {(kind, regime): x for kind, regime, *x in REGIMES}
    factor = [F.lit(1.0)] * 3
    for kind, c in (("volatility", volatility), ("trend", trend), ("structure", structure)):
        for i in range(3):
            table = _map({regime: x[i] for (k, regime), x in m.items() if k == kind})
            factor[i] = factor[i] * F.coalesce(F.try_element_at(table, F.col(c)), F.lit(1.0))
    bars = F.greatest(F.lit(1), F.bround(F.col("max_bars") * factor[2], 0).cast("int"))
    return df.withColumns({"k_up": F.bround(F.col("k_up") * factor[0], 4), "k_down": F.bround(F.col("k_down") * factor[1], 4), "max_bars": bars})


def default_curve(horizon: int) -> tuple[float, int]:
    """(multiple, most bars) that grow with the logarithm of the horizon and with the horizon."""
    return min(4.0, max(0.5, 0.8 + 0.4 * math.log2(horizon))), int(min(300, max(5, 2.5 * horizon)))


def most_bars() -> int:
    return max(x[-1] for x in (*BARRIERS, *BARRIERS_DEFAULT, *THRESHOLDS))


def timeframe_minutes(name: str) -> int:
    """Minutes of 15min, 4h or 1d."""
    for unit, n in (("min", 1), ("h", 60), ("d", 1440)):
        if name.endswith(unit) and name[: -len(unit)].isdigit() and int(name[: -len(unit)]) > 0:
            return int(name[: -len(unit)]) * n
    raise ValueError(f"{name!r} is no timeframe")


def scaled_period(period: int, source: int, target: int, least: int = 2) -> int:
    """A period of bars of source minutes in bars of target minutes, rounded half to even."""
    return max(least, round(period * source / target))


def horizon_guards(horizon: int, minutes: int) -> tuple[int, int]:
    """(purge, embargo) in bars."""
    return 3 * horizon, 7200 // minutes


def _easter(year: int) -> tuple[int, int]:
    g, c = year % 19, year // 100
    h = (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30
    i = h - h // 28 * (1 - 29 // (h + 1) * ((21 - g) // 11))
    j = (year + year // 4 + i + 2 - c + c // 4) % 7
    m = 3 + (i - j + 40) // 44
    return m, i - j + 28 - 31 * (m // 4)


def market_days(spark: SparkSession, years: range) -> DataFrame:
    """day, kind: holidays and early closes by rule: fixed dates (from Saturday to Friday before, from Sunday to Monday after), nth weekdays, Good Friday."""
    from datetime import date, timedelta

    def nth(y: int, m: int, weekday: int, n: int) -> date:
        first = date(y, m, 1)
        at = first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
        return at

    def observed(d: date) -> date:
        return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d

    rows = []
    for y in years:
        easter = date(y, *_easter(y))
        last_monday = max(d for d in (nth(y, 5, 0, n) for n in (4, 5)) if d.month == 5)
        thanks, fourth = nth(y, 11, 3, 4), observed(date(y, 7, 4))
        for d in (observed(date(y, 1, 1)), nth(y, 1, 0, 3), nth(y, 2, 0, 3), easter - timedelta(2), last_monday, observed(date(y, 6, 19)), fourth, nth(y, 9, 0, 1), thanks, observed(date(y, 12, 25))):
            rows.append((d, "holiday"))
        for d in (fourth - timedelta(1), thanks + timedelta(1), *(date(y, m, x) for m, x in EARLY)):
            rows.append((d, "early_close"))
    return spark.createDataFrame(rows, "day date, kind string")
