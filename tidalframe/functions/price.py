"""Price, moving-average and momentum features; each is the value of the bar before (lag 1) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import Rolling, log, ratio


def returns(r: Rolling, periods=(1, 5, 10, 20, 60)) -> dict[str, Column]:
    out = {}
    for n in periods:
        q = ratio(r.lag(r.c), r.lag(r.c, n + 1))
        out |= {f"return_{n}": q - 1, f"log_return_{n}": log(q)}
    return out


def price_ratios(r: Rolling) -> dict[str, Column]:
    return {"hl_ratio": ratio(r.lag(r.h), r.lag(r.l)), "co_ratio": ratio(r.lag(r.c), r.lag(r.o)), "range_pct": ratio(r.lag(r.h) - r.lag(r.l), r.lag(r.c))}


def autocorrelation(r: Rolling, lags=(1, 2, 5, 10), period: int = 20) -> dict[str, Column]:
    """Correlation of the last returns with themselves k bars earlier, both within the last `period` returns."""
    out = {}
    for k in lags:
        ret = lambda d: ratio(r.lag(r.c, d), r.lag(r.c, d + 1)) - 1
        now, then = ret(1), ret(1 + k)
        n = period - k
        frame = r.rows(n)
        out[f"autocorr_{k}"] = F.when((F.count(now).over(frame) == n) & (F.count(then).over(frame) == n), F.corr(now, then).over(frame))
    return out


def clv(r: Rolling) -> dict[str, Column]:
    return {"clv": r.lag(ratio(r.c * 2 - r.h - r.l, r.h - r.l))}


def sma(r: Rolling, periods=(10, 20, 50, 100, 200)) -> dict[str, Column]:
    out = {}
    for n in periods:
        m = r.mean(r.lag(r.c), n)
        out |= {f"sma_{n}": m, f"price_to_sma_{n}": ratio(r.lag(r.c), m) - 1}
    return out


def stochastic(r: Rolling, k: int = 14, d: int = 3) -> dict[str, Column]:
    hh, ll = r.max(r.lag(r.h), k), r.min(r.lag(r.l), k)
    pk = F.when(hh == ll, F.lit(50.0)).otherwise(ratio((r.lag(r.c) - ll) * 100, hh - ll))
    return {"stoch_k": pk, "stoch_d": r.mean(pk, d), "stoch_overbought": F.coalesce((pk > 80).cast("int"), F.lit(0)), "stoch_oversold": F.coalesce((pk < 20).cast("int"), F.lit(0))}


def williams_r(r: Rolling, n: int = 14) -> dict[str, Column]:
    hh, ll = r.max(r.lag(r.h), n), r.min(r.lag(r.l), n)
    return {"williams_r": ratio((hh - r.lag(r.c)) * -100, hh - ll)}


def roc(r: Rolling, periods=(5, 10, 20)) -> dict[str, Column]:
    return {f"roc_{n}": ratio((r.lag(r.c) - r.lag(r.c, n + 1)) * 100, r.lag(r.c, n + 1)) for n in periods}


def cci(r: Rolling, n: int = 20) -> dict[str, Column]:
    tp = r.lag((r.h + r.l + r.c) / 3)
    m = r.mean(tp, n)
    mad = F.aggregate(r.values(tp, n), F.struct(F.lit(0.0).alias("s"), m.alias("m")), lambda a, x: F.struct((a["s"] + F.abs(x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"] / n)
    return {"cci_20": ratio(tp - m, mad * 0.015)}


def mfi(r: Rolling, n: int = 14) -> dict[str, Column]:
    tp, before = r.lag((r.h + r.l + r.c) / 3), r.lag((r.h + r.l + r.c) / 3, 2)
    flow = tp * r.lag(r.v)
    up = F.when(flow.isNotNull(), F.when(tp > before, flow).otherwise(0.0))
    down = F.when(flow.isNotNull(), F.when(tp < before, flow).otherwise(0.0))
    return {"mfi_14": F.lit(100.0) - F.lit(100.0) / (ratio(r.sum(up, n), r.sum(down, n)) + 1)}
