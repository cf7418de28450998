"""Volatility, volume and microstructure features; each is the value of the bar before (lag 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import Rolling, log, ratio

#: Square root of 5-minute bars a year (78 a day, 252 days), the annualisation of all range estimators.
ANNUAL = math.sqrt(78 * 252)


def bollinger(r: Rolling, n: int = 20, mult: float = 2.0) -> dict[str, Column]:
    m, s, p = r.mean(r.lag(r.c), n), r.std(r.lag(r.c), n), r.lag(r.c)
    up, low = m + s * mult, m - s * mult
    return {"bb_middle": m, "bb_upper": up, "bb_lower": low, "bb_width": ratio(up - low, s), "bb_position": ratio(p - low, up - low), "close_bb_zscore": ratio(p - m, s)}


def historical(r: Rolling, periods=(10, 20, 60)) -> dict[str, Column]:
    ret = log(ratio(r.lag(r.c), r.lag(r.c, 2)))
    return {f"hvol_{n}": r.std(ret, n) * ANNUAL for n in periods}


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)) * ANNUAL


def parkinson(r: Rolling, n: int = 20) -> dict[str, Column]:
    return {"parkinson_vol": _root(r.mean(F.pow(log(ratio(r.lag(r.h), r.lag(r.l))), 2), n) / (4 * math.log(2)))}


def garman_klass(r: Rolling, n: int = 20) -> dict[str, Column]:
    x = F.pow(log(ratio(r.lag(r.h), r.lag(r.l))), 2) * 0.5 - F.pow(log(ratio(r.lag(r.c), r.lag(r.o))), 2) * (2 * math.log(2) - 1)
    return {"gk_vol": _root(r.mean(x, n))}


def _rs(r: Rolling) -> Column:
    ho, hc, lo, lc = (log(ratio(r.lag(a), r.lag(b))) for a, b in ((r.h, r.o), (r.h, r.c), (r.l, r.o), (r.l, r.c)))
    return hc * ho + lc * lo


def rogers_satchell(r: Rolling, n: int = 20) -> dict[str, Column]:
    return {"rs_vol": _root(r.mean(_rs(r), n))}


def yang_zhang(r: Rolling, n: int = 20) -> dict[str, Column]:
    """Squared deviations are from the rolling mean at their own bar."""
    night, day = log(ratio(r.lag(r.o), r.lag(r.c, 2))), log(ratio(r.lag(r.c), r.lag(r.o)))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    spread = lambda x: r.mean(F.pow(x - r.mean(x, n), 2), n)
    return {"yz_vol": _root(spread(night) + spread(day) * k + r.mean(_rs(r), n) * (1 - k))}


def moments(r: Rolling, periods=(20, 60)) -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis of returns."""
    ret = ratio(r.lag(r.c), r.lag(r.c, 2)) - 1
    out = {}
    for n in periods:
        s, k = F.skewness(ret).over(r.rows(n)), F.kurtosis(ret).over(r.rows(n))
        out[f"return_skew_{n}"] = r.full(n, ret, s * math.sqrt(n * (n - 1)) / (n - 2))
        out[f"return_kurt_{n}"] = r.full(n, ret, (k * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return out


def volume(r: Rolling, n: int = 20) -> dict[str, Column]:
    m, s = r.mean(r.lag(r.v), n), r.std(r.lag(r.v), n)
    return {"volume_sma_20": m, "volume_ratio": ratio(r.lag(r.v), m), "volume_zscore": ratio(r.lag(r.v) - m, s)}


def dollar_volume(r: Rolling, periods=(10, 20)) -> dict[str, Column]:
    d = r.lag(r.c * r.v)
    return {"dollar_volume": d} | {f"dollar_volume_sma_{n}": r.mean(d, n) for n in periods} | {"dollar_volume_ratio": ratio(d, r.mean(d, 20))}


def _ret(r: Rolling, d: int = 1) -> Column:
    return ratio(r.lag(r.c, d), r.lag(r.c, d + 1)) - 1


def amihud(r: Rolling, periods=(10, 20)) -> dict[str, Column]:
    a = ratio(F.abs(_ret(r)), r.lag(r.v))
    return {"micro_amihud": a} | {f"micro_amihud_{n}": r.mean(a, n) for n in periods}


def roll_spread(r: Rolling, n: int = 20) -> dict[str, Column]:
    d, e = r.lag(r.c) - r.lag(r.c, 2), r.lag(r.c, 2) - r.lag(r.c, 3)
    both = F.count(F.when(d.isNotNull() & e.isNotNull(), 1)).over(r.rows(n)) == n
    s = F.when(both, F.sqrt(F.greatest(-F.covar_samp(d, e).over(r.rows(n)), F.lit(0.0))) * 2)
    return {"micro_roll_spread": s, "micro_roll_spread_pct": ratio(s, r.lag(r.c))}


def kyle_lambda(r: Rolling, n: int = 20) -> dict[str, Column]:
    return {"micro_kyle_lambda": ratio(F.abs(_ret(r)), r.mean(r.lag(r.v), n))}


def corwin_schultz(r: Rolling) -> dict[str, Column]:
    b1, b2 = (F.pow(log(ratio(r.lag(r.h, d), r.lag(r.l, d))), 2) for d in (1, 2))
    beta = b1 + b2
    gamma = F.pow(log(ratio(F.greatest(r.lag(r.h), r.lag(r.h, 2)), F.least(r.lag(r.l), r.lag(r.l, 2)))), 2)
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(beta * 2) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    a = F.when(alpha.isNotNull(), F.greatest(F.least(alpha, F.lit(10.0)), F.lit(-10.0)))
    return {"micro_cs_spread": F.when(a.isNotNull(), F.greatest((F.exp(a) - 1) * 2 / (F.exp(a) + 1), F.lit(0.0)))}


def relative_spread(r: Rolling, periods=(10, 20)) -> dict[str, Column]:
    s = r.lag(ratio(r.h - r.l, r.c))
    return {"micro_rel_spread": s} | {f"micro_rel_spread_{n}": r.mean(s, n) for n in periods}


def volume_imbalance(r: Rolling, n: int = 20) -> dict[str, Column]:
    x = r.lag(ratio(r.c - r.o, r.h - r.l))
    return {"micro_volume_imbalance": x, "micro_cum_imbalance_20": r.sum(x, n)}


def trade_intensity(r: Rolling, periods=(20, 50)) -> dict[str, Column]:
    return {f"micro_trade_intensity_{n}": ratio(r.lag(r.v), r.mean(r.lag(r.v), n)) for n in periods}


def efficiency(r: Rolling, periods=(10, 20)) -> dict[str, Column]:
    step = F.abs(r.lag(r.c) - r.lag(r.c, 2))
    return {f"micro_efficiency_{n}": ratio(F.abs(r.lag(r.c) - r.lag(r.c, n + 1)), r.sum(step, n)) for n in periods}


def vol_ratio(r: Rolling, short: int = 5, long: int = 20) -> dict[str, Column]:
    return {"micro_vol_ratio": ratio(r.std(_ret(r), short), r.std(_ret(r), long))}


def microstructure(r: Rolling) -> dict[str, Column]:
    out = {}
    for f in (amihud, roll_spread, kyle_lambda, corwin_schultz, relative_spread, volume_imbalance, trade_intensity, efficiency, vol_ratio):
        out |= f(r)
    return out
