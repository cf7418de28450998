"""Feature queries over daily bars."""

from __future__ import annotations

import math

from ..functions import price, volatility
from ..series import Rolling, with_features
from ..sources.bars import LI_BARS_SQL, li_bars
from .registry import query, rounded


def _features(make, back: int, *more, raw: tuple[str, ...] = ()):
    """A query of the features of one or more functions of Rolling."""

    def run(spark, sf_dir):
        r = Rolling.of_blocks()
        cols = {}
        for f in (make, *more):
            cols |= f(r)
        return rounded(with_features(li_bars(spark, sf_dir), cols, back, keep=["symbol", "datetime"]), raw=raw)

    return run


W = "PARTITION BY symbol ORDER BY datetime"


def full(n: int, held: str, value: str) -> str:
    """value, an aggregate with OVER left out as @, where the last n rows hold n values of held."""
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({held}) {over} = {n} THEN {value.replace('@', over)} END"


def mean(x: str, n: int) -> str:
    return full(n, x, f"avg({x}) @")


def std(x: str, n: int) -> str:
    return full(n, x, f"stddev_samp({x}) @")


_LAGS = ", ".join(f"lag({c}, {k}) OVER ({W}) AS {c[0]}{k}" for c in ("open", "high", "low", "close", "volume") for k in (1, 2, 3))
_CLOSES = ", ".join(f"lag(close, {k}) OVER ({W}) AS c{k}" for k in range(4, 62))
BASE = f"WITH {LI_BARS_SQL}, f AS (SELECT symbol, datetime, {_LAGS}, {_CLOSES} FROM b)"


def sql(cols: dict[str, str], *steps: dict[str, str], raw: tuple[str, ...] = ()) -> str:
    """The last of cols, *steps over the lagged bars, each step over the columns of the one before."""
    out, src = BASE, "f"
    for i, s in enumerate((cols, *steps)[:-1]):
        out += f",\ns{i} AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in s.items())} FROM {src})"
        src = f"s{i}"
    last = (cols, *steps)[-1]
    return out + f"\nSELECT symbol, datetime, {', '.join(f'CAST({e[4:]} AS INTEGER) AS {k}' if e.startswith('INT ') else f'{e} AS {k}' if k in raw else f'round({e}, 6) AS {k}' for k, e in last.items())} FROM {src}"


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def add(name: str, functions, back: int, *steps: dict[str, str], raw: tuple[str, ...] = ()) -> None:
    query(name, sql(*steps, raw=raw))(_features(functions[0], back, *functions[1:], raw=raw))


P = (1, 5, 10, 20, 60)
add("returns", [price.returns], 61, {k: e for n in P for k, e in ((f"return_{n}", f"c1 / nullif(c{n + 1}, 0) - 1"), (f"log_return_{n}", ln(f"(c1 / nullif(c{n + 1}, 0))")))})
add("price_ratios", [price.price_ratios, price.clv], 2, {"hl_ratio": "h1 / nullif(l1, 0)", "co_ratio": "c1 / nullif(o1, 0)", "range_pct": "(h1 - l1) / nullif(c1, 0)", "clv": "(2 * c1 - h1 - l1) / nullif(h1 - l1, 0)"})
add("autocorr", [price.autocorrelation], 32, {f"r{k}": f"c{k} / nullif(c{k + 1}, 0) - 1" for k in (1, 2, 3, 6, 11)},
    {f"autocorr_{k}": f"CASE WHEN count(r{k + 1}) OVER ({W} ROWS BETWEEN {19 - k} PRECEDING AND CURRENT ROW) = {20 - k} THEN corr(r1, r{k + 1}) OVER ({W} ROWS BETWEEN {19 - k} PRECEDING AND CURRENT ROW) END" for k in (1, 2, 5, 10)})
add("sma_ratio", [price.sma], 201, {k: e for n in (10, 20, 50, 100, 200) for k, e in ((f"sma_{n}", mean("c1", n)), (f"price_to_sma_{n}", f"c1 / nullif({mean('c1', n)}, 0) - 1"))})
_HL = {"hh": full(14, "h1", "max(h1) @"), "ll": full(14, "l1", "min(l1) @")}
add("stochastic", [price.stochastic], 18, _HL, {"k": "CASE WHEN hh = ll THEN 50.0 ELSE (c1 - ll) * 100 / nullif(hh - ll, 0) END"},
    {"stoch_k": "k", "stoch_d": mean("k", 3), "stoch_overbought": "INT coalesce(k > 80, false)", "stoch_oversold": "INT coalesce(k < 20, false)"})
add("williams_roc", [price.williams_r, price.roc], 22, _HL, {"williams_r": "(hh - c1) * -100 / nullif(hh - ll, 0)"} | {f"roc_{n}": f"(c1 - c{n + 1}) * 100 / nullif(c{n + 1}, 0)" for n in (5, 10, 20)})
add("cci_mad", [price.cci], 22, {"tp": "(h1 + l1 + c1) / 3"}, {"m": mean("tp", 20), "v": full(20, "tp", "list(tp) @")}, {"cci_20": "(tp - m) / nullif(0.015 * list_avg(list_transform(v, lambda x: abs(x - m))), 0)"})
add("mfi", [price.mfi], 17, {"tp": "(h1 + l1 + c1) / 3", "tp0": "(h2 + l2 + c2) / 3"}, {"up": "CASE WHEN tp IS NULL THEN NULL WHEN tp > tp0 THEN tp * v1 ELSE 0 END", "dn": "CASE WHEN tp IS NULL THEN NULL WHEN tp < tp0 THEN tp * v1 ELSE 0 END"},
    {"mfi_14": f"100 - 100 / (1 + {full(14, 'up', 'sum(up) @')} / nullif({full(14, 'dn', 'sum(dn) @')}, 0))"})
_BB = {"m": mean("c1", 20), "s": std("c1", 20)}
add("bollinger", [volatility.bollinger], 22, _BB, {"bb_middle": "m", "bb_upper": "m + 2 * s", "bb_lower": "m - 2 * s", "bb_width": "((m + 2 * s) - (m - 2 * s)) / nullif(s, 0)", "bb_position": "(c1 - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)", "close_bb_zscore": "(c1 - m) / nullif(s, 0)"})
_A = f"sqrt({78 * 252})"
_X = {"hl": ln("(h1 / nullif(l1, 0))"), "co": ln("(c1 / nullif(o1, 0))"), "ho": ln("(h1 / nullif(o1, 0))"), "hc": ln("(h1 / nullif(c1, 0))"), "lo": ln("(l1 / nullif(o1, 0))"), "lc": ln("(l1 / nullif(c1, 0))"), "oc": ln("(o1 / nullif(c2, 0))"), "r": ln("(c1 / nullif(c2, 0))")}
_X2 = {"pk": "hl * hl", "gk": f"0.5 * hl * hl - {2 * math.log(2) - 1} * co * co", "rs": "hc * ho + lc * lo", "dn": f"pow(oc - {mean('oc', 20)}, 2)", "dd": f"pow(co - {mean('co', 20)}, 2)"}
_K = 0.34 / (1.34 + 21 / 19)
root = lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END * {_A}"
add("range_vols", [volatility.historical, volatility.parkinson, volatility.garman_klass, volatility.rogers_satchell, volatility.yang_zhang], 62, _X, _X2,
    {f"hvol_{n}": f"{std('r', n)} * {_A}" for n in (10, 20, 60)} | {"parkinson_vol": root(f"({mean('pk', 20)}) / {4 * math.log(2)}"), "gk_vol": root(f"({mean('gk', 20)})"), "rs_vol": root(f"({mean('rs', 20)})"),
     "yz_vol": root(f"(({mean('dn', 20)}) + {_K} * ({mean('dd', 20)}) + {1 - _K} * ({mean('rs', 20)}))")})
add("moments", [volatility.moments], 63, {"r": "c1 / nullif(c2, 0) - 1"}, {k: e for n in (20, 60) for k, e in ((f"return_skew_{n}", full(n, "r", "skewness(r) @")), (f"return_kurt_{n}", full(n, "r", "kurtosis(r) @")))})
add("volume_stats", [volatility.volume, volatility.dollar_volume], 22, {"d": "c1 * v1"},
    {"volume_sma_20": mean("v1", 20), "volume_ratio": f"v1 / nullif({mean('v1', 20)}, 0)", "volume_zscore": f"(v1 - {mean('v1', 20)}) / nullif({std('v1', 20)}, 0)", "dollar_volume": "d", "dollar_volume_sma_10": mean("d", 10), "dollar_volume_sma_20": mean("d", 20), "dollar_volume_ratio": f"d / nullif({mean('d', 20)}, 0)"}, raw=("dollar_volume",))
_M = {"ret": "c1 / nullif(c2, 0) - 1", "d1": "c1 - c2", "d2": "c2 - c3", "beta": "pow(ln(h1 / l1), 2) + pow(ln(h2 / l2), 2)", "gamma": "CASE WHEN h2 IS NOT NULL THEN pow(ln(greatest(h1, h2) / least(l1, l2)), 2) END", "sp": "(h1 - l1) / nullif(c1, 0)", "vi": "(c1 - o1) / nullif(h1 - l1, 0)", "st": "abs(c1 - c2)"}
_M2 = {"am": "abs(ret) / nullif(v1, 0)", "al": f"(sqrt(2 * beta) - sqrt(beta)) / {3 - 2 * math.sqrt(2)} - sqrt(gamma / {3 - 2 * math.sqrt(2)})"}
_M3 = {"ca": "CASE WHEN al IS NOT NULL THEN greatest(least(al, 10.0), -10.0) END", "rl": full(20, "d2", "2 * sqrt(greatest(-(covar_samp(d1, d2) @), 0))")}
add("microstructure", [volatility.microstructure], 53, _M, _M2, _M3,
    {"micro_amihud": "am", "micro_amihud_10": mean("am", 10), "micro_amihud_20": mean("am", 20), "micro_roll_spread": "rl", "micro_roll_spread_pct": "rl / nullif(c1, 0)", "micro_kyle_lambda": f"abs(ret) / nullif({mean('v1', 20)}, 0)",
     "micro_cs_spread": "CASE WHEN ca IS NOT NULL THEN greatest(2 * (exp(ca) - 1) / (1 + exp(ca)), 0) END", "micro_rel_spread": "sp", "micro_rel_spread_10": mean("sp", 10), "micro_rel_spread_20": mean("sp", 20), "micro_volume_imbalance": "vi", "micro_cum_imbalance_20": full(20, "vi", "sum(vi) @"),
     "micro_trade_intensity_20": f"v1 / nullif({mean('v1', 20)}, 0)", "micro_trade_intensity_50": f"v1 / nullif({mean('v1', 50)}, 0)", "micro_efficiency_10": f"abs(c1 - c11) / nullif({full(10, 'st', 'sum(st) @')}, 0)", "micro_efficiency_20": f"abs(c1 - c21) / nullif({full(20, 'st', 'sum(st) @')}, 0)", "micro_vol_ratio": f"{std('ret', 5)} / nullif({std('ret', 20)}, 0)"})
