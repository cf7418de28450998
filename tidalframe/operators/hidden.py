"""Hidden Markov regimes: a Gaussian model of returns, refitted on all bars so far every few bars.

A series is cut into blocks.  Over a block, the forward pass of a model is a product of small matrices (emission times
transition, kept at length 1 with a logarithm beside it), and such products can be taken block by block, put together in
order, and used to start each block's own forward and backward pass.  So a step of expectation
maximisation over a long series is: the matrices of all blocks, one narrow pass over each model's
matrices, the sums of all blocks, new parameters.  A model whose bars lie in one block needs no such step between tasks and is fitted in
one; the models of a symbol are dealt to tasks by their refits.  Bars between refits look back a fixed number of rows, in
groups of one refit.

Defined cases: bars without a return (the first, a price that is null or not above 0) have no observation and are passed over; a
refit on less than 10 observations a state gives no model, and its bars have no regime; a symbol with too few bars has
none; ties between starts go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..series import INDEX, KEY, TIME, Rolling, blocked, indexed
from ..tables import kept

# Names of the states in order of variance.
LABELS = {2: ("low_vol", "high_vol"), 3: ("low_vol", "normal", "high_vol"), 4: ("low_vol", "normal", "high_vol", "crisis")}
_TINY = 1e-300
#: Refits that one task fits together.
TOGETHER = 4


@dataclass(frozen=True)
class Settings:
    """scatter is added to each state's sum of squares (a weak prior); a fit ends when the log-likelihood gains less than tol."""

    states: int = 3
    lookback: int = 252
    every: int = 50
    starts: int = 10
    max_iter: int = 100
    tol: float = 1e-2
    scatter: float = 1e-2
    seed: int = 42
    block: int = 65_536

    @property
    def first(self) -> int:
        """The bar of the first refit."""
        return max(self.lookback, self.states * 20)

    @property
    def labels(self) -> tuple[str, ...]:
        return LABELS.get(self.states) or tuple(f"state_{i}" for i in range(self.states))


class Models:
    """Parameters of P models of K states: start (P, K), move (P, K, K), mean and var (P, K)."""

    def __init__(self, start, move, mean, var):
        self.start, self.move, self.mean, self.var = (np.asarray(a, dtype=float) for a in (start, move, mean, var))
        self.k = self.mean.shape[1]

    @classmethod
    def unpacked(cls, rows: np.ndarray, k: int) -> Models:
        at = np.cumsum([0, k, k * k, k, k])
        a, b, c, d = (rows[:, lo:hi] for lo, hi in zip(at, at[1:], strict=False))
        return cls(a, b.reshape(-1, k, k), c, d)

    def packed(self) -> np.ndarray:
        return np.hstack([self.start, self.move.reshape(len(self.start), -1), self.mean, self.var])

    def take(self, which) -> Models:
        return Models(self.start[which], self.move[which], self.mean[which], self.var[which])

    def ordered(self) -> Models:
        """States in ascending order of variance."""
        o = np.argsort(self.var, axis=1, kind="stable")
        at = np.arange(len(o))[:, None]
        return Models(self.start[at, o], self.move[at[:, :, None], o[:, :, None], o[:, None, :]], self.mean[at, o], self.var[at, o])

    def emission(self, x: float | np.ndarray) -> np.ndarray:
        """Log densities (P, K); x is one value or one a model."""
        d = np.reshape(x, (-1, 1)) - self.mean
        return -0.5 * (d * d / self.var + np.log(2 * np.pi * self.var))


def begun(mean: float, std: float, s: Settings) -> Models:
    """The starts of a fit: means about the overall one by seeded normal draws, the same for all series."""
    draws = np.array([np.sort(np.random.default_rng(s.seed + i).normal(size=s.states)) for i in range(s.starts)])
    even = np.full((s.starts, s.states), 1 / s.states)
    return Models(even, np.repeat(even[:, :, None], s.states, axis=2), mean + std * draws, np.full_like(even, std * std + s.scatter / 10))


def forward(x: np.ndarray, ends: np.ndarray, m: Models, v: np.ndarray, keep: bool = False):
    """(v after the rows, log scale, posterior of the last row, [v before each row], [emissions]).

    v (P, K): how likely each state is before a row is seen; model p sees the first ends[p] values alone; x is (T,) or (T, P).
    """
    t_all, ll, last = len(x), np.zeros(len(v)), v
    vs, bs = (np.empty((t_all, *v.shape)), np.empty((t_all, *v.shape))) if keep else (None, None)
    for t in range(t_all):
        e = m.emission(x[t])
        top = e.max(axis=1, keepdims=True)
        b = np.maximum(np.exp(e - top), _TINY)
        if keep:
            vs[t], bs[t] = v, b
        a = v * b
        s = np.maximum(a.sum(axis=1, keepdims=True), _TINY)
        a = a / s
        on = (t < ends)[:, None]
        v = np.where(on, np.einsum("pi,pij->pj", a, m.move), v)
        last = np.where(on, a, last)
        ll += np.where(on, np.log(s) + top, 0.0)[:, 0]
    return v, ll, last, vs, bs


def likeliest(x: np.ndarray, ends: np.ndarray, m: Models, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log v after the rows, last state of the likeliest path) from log v before them."""
    move = np.log(np.maximum(m.move, _TINY))
    state = np.argmax(v, axis=1)
    for t in range(len(x)):
        d = v + m.emission(x[t])
        on = t < ends
        state = np.where(on, np.argmax(d, axis=1), state)
        v = np.where(on[:, None], (d[:, :, None] + move).max(axis=1), v)
    return v, state


def sums(x: np.ndarray, ends: np.ndarray, more: np.ndarray, m: Models, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums for new parameters, log scale) of a block: v before its rows, u the likelihood of what follows it.

    more: whether a model sees rows after this block; x is (T,) or (T, P).  A model's sums are the first row's posterior (K), pairs (K, K), weights, values and squares (K each).
    """
    _, ll, _, vs, bs = forward(x, ends, m, v, keep=True)
    k = m.k
    pairs, n, s1, s2, first = np.zeros_like(m.move), *(np.zeros_like(v) for _ in range(4))
    for t in range(len(x) - 1, -1, -1):
        on = (t < ends)[:, None]
        a = vs[t] * bs[t]
        au = np.einsum("pij,pj->pi", m.move, u)
        g = a * au
        z = np.maximum(g.sum(axis=1, keepdims=True), _TINY)
        g = np.where(on, g / z, 0.0)
        gx, row = g * np.reshape(x[t], (-1, 1)), np.reshape(x[t], (-1, 1))
        n, s1, s2, first = n + g, s1 + gx, s2 + gx * row, np.where(on, g, first)
        paired = on & ((t + 1 < ends) | more)[:, None]
        pairs += np.where(paired[:, :, None], a[:, :, None] * m.move * u[:, None, :] / z[:, :, None], 0.0)
        w = bs[t] * au
        u = np.where(on, w / np.maximum(w.max(axis=1, keepdims=True), _TINY), u)
    return np.hstack([first, pairs.reshape(len(v), k * k), n, s1, s2]), ll


def joined(v: np.ndarray, a: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, log scale) after a block of matrices a (P, K, K), whose rows have log scales (P, K)."""
    top = scale.max(axis=1, keepdims=True)
    w = v * np.exp(scale - top)
    total = np.maximum(w.sum(axis=1, keepdims=True), _TINY)
    return np.einsum("pi,pij->pj", w, a) / total, (top + np.log(total))[:, 0]


def joined_back(u: np.ndarray, a: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Likelihood of all that follows from before a block, from that of what follows it."""
    w = np.exp(scale - scale.max(axis=1, keepdims=True)) * np.einsum("pij,pj->pi", a, u)
    return w / np.maximum(w.max(axis=1, keepdims=True), _TINY)


def matrices_of(x: np.ndarray, ends: np.ndarray, m: Models) -> tuple[np.ndarray, np.ndarray]:
    """A block's product for each model, and the log scales of its rows."""
    p, k = m.mean.shape
    each = m.take(np.repeat(np.arange(p), k))
    v, ll, *_ = forward(np.repeat(x, k, axis=1) if x.ndim > 1 else x, np.repeat(ends, k), each, np.tile(np.eye(k), (p, 1)))
    return v.reshape(p, k, k), ll.reshape(p, k)


def stretched_sums(x: np.ndarray, ends: np.ndarray, more: np.ndarray, m: Models, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sums(), with the rows cut into as many stretches as each has rows, all worked on together."""
    long = max(int(np.sqrt(len(x))), 1)
    n, p = -(-len(x) // long), len(v)
    rows = np.repeat(np.pad(x, (0, n * long - len(x))).reshape(n, long).T, p, axis=1)
    each = m.take(np.tile(np.arange(p), n))
    before = np.repeat(np.arange(n) * long, p)
    all_ends = np.tile(ends, n)
    here = np.clip(all_ends - before, 0, long)
    a, scale = (z.reshape(n, p, *z.shape[1:]) for z in matrices_of(rows, here, each))
    vs, us = [v], [u]
    for i in range(n - 1):
        vs.append(joined(vs[-1], a[i], scale[i])[0])
        us.append(joined_back(us[-1], a[n - 1 - i], scale[n - 1 - i]))
    got, ll = sums(rows, here, (all_ends > before + long) | np.tile(more, n), each, np.vstack(vs), np.vstack(us[::-1]))
    got = got.reshape(n, p, -1)
    total = got.sum(axis=0)
    total[:, : m.k] = got[0, :, : m.k]  # the first row is in the first stretch
    return total, ll.reshape(n, p).sum(axis=0)


def maximised(total: np.ndarray, k: int, scatter: float) -> Models:
    """Parameters from the sums over all of a model's blocks."""
    first, pairs, n, s1, s2 = np.split(total, np.cumsum([k, k * k, k, k]), axis=1)
    pairs = pairs.reshape(-1, k, k)
    out = pairs.sum(axis=2, keepdims=True)
    move = np.where(out > 0, pairs / np.maximum(out, _TINY), 1 / k)
    n = np.maximum(n, _TINY)
    mean = s1 / n
    return Models(first / np.maximum(first.sum(axis=1, keepdims=True), _TINY), move, mean, (np.maximum(s2 - n * mean * mean, 0.0) + scatter) / n)


def fitted(x: np.ndarray, ends: np.ndarray, m: Models, s: Settings) -> Models:
    """Expectation maximisation of models that see the first ends[p] values of x, each until it converges."""
    p = m.packed()
    before, open_ = np.full(len(p), -np.inf), np.arange(len(p))
    for _ in range(s.max_iter):
        now = Models.unpacked(p[open_], s.states)
        e = ends[open_]
        total, ll = stretched_sums(x[: e.max()], e, np.zeros(len(e), dtype=bool), now, now.start, np.ones_like(now.start))
        p[open_] = maximised(total, s.states, s.scatter).packed()
        on = ll - before[open_] >= s.tol
        before[open_] = ll
        open_ = open_[on]
        if not len(open_):
            break
    return Models.unpacked(p, s.states)


def returns(close: Column, r: Rolling) -> Column:
    """The logarithm of a close over the one before it; null where either is not above 0."""
    before = r.lag(close)
    return F.when((close > 0) & (before > 0), F.ln(close / before))


_BLOCKS = "x array<double>"
_FIT = "refit long, start int, p array<double>, ll double, state int, probs array<double>"


def _known(x) -> np.ndarray:
    x = np.array(x, dtype=float)
    return x[~np.isnan(x)]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _short(refits: DataFrame, blocks: DataFrame, s: Settings, kind: str) -> DataFrame:
    """The best start of each refit that lies in its symbol's first block: its packed model, state and probabilities at its bar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for symbol, x, todo in b[[KEY, "x", "todo"]].itertuples(index=False):
                x = np.array(x, dtype=float)
                seen = np.concatenate([[0], np.cumsum(~np.isnan(x))])
                known, rows = _known(x), []
                todo = sorted((int(r["refit"]), int(seen[r["end"]])) for r in todo)
                todo = [(r, n) for r, n in todo if n >= 10 * s.states]
                if not todo:
                    continue
                starts = [begun(known[:n].mean(), known[:n].std(), s).packed() for _, n in todo]
                ends = np.repeat([n for _, n in todo], s.starts)
                known = known[: ends.max()]
                m = fitted(known, ends, Models.unpacked(np.vstack(starts), s.states), s)
                _, ll, *_ = forward(known, ends, m, m.start)
                best = np.argmax(ll.reshape(len(todo), s.starts), axis=1)
                m = m.take(best + s.starts * np.arange(len(todo))).ordered()
                ends = ends[:: s.starts]
                _, ll, probs, *_ = forward(known, ends, m, m.start)
                _, state = likeliest(known, ends, m, np.log(np.maximum(m.start, _TINY)))
                for i, (refit, _) in enumerate(todo):
                    rows.append((symbol, refit, int(best[i]), m.packed()[i].tolist(), float(ll[i]), int(state[i]), probs[i].tolist()))
                yield pd.DataFrame(rows, columns=[KEY, "refit", "start", "p", "ll", "state", "probs"])

    todo = refits.groupBy(KEY, F.floor(F.col("refit") / TOGETHER).alias("_g")).agg(F.collect_list(F.struct("refit", "end")).alias("todo"))
    jobs = todo.join(blocks.where("blk = 0"), KEY).select(KEY, "x", "todo")
    # By number: a task's work is in its refits, not in its bytes.
    spread = jobs.repartition(_tasks(jobs), KEY, F.element_at("todo", 1)["refit"])
    return spread.mapInPandas(run, f"{KEY} {kind}, {_FIT}")


def _per_block(jobs: DataFrame, make, schema: str) -> DataFrame:
    """make(values, models, refits, starts, row) for each block and group of models that see it; jobs has x, at (rows before the block) and models."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                x = np.array(row.x, dtype=float)
                seen = np.concatenate([[0], np.cumsum(~np.isnan(x))])
                held = list(row.models)
                ends = np.array([seen[min(max(int(h["end"]) - int(row.at), 0), len(x))] for h in held])
                yield make(_known(x), ends, held, row)

    return jobs.mapInPandas(run, schema)


def _long(refits: DataFrame, blocks: DataFrame, s: Settings, kind: str) -> DataFrame:
    """As _short, for refits that see several blocks: steps of expectation maximisation over all blocks, a few Spark jobs a step."""
    k = s.states
    unpack = lambda held: Models.unpacked(np.array([h["p"] for h in held], dtype=float), k)
    # Moments of each refit's values give its starts.
    seen = F.filter(F.slice("x", F.lit(1), F.least(F.col("end") - F.col("at"), F.size("x")).cast("int")), lambda v: ~F.isnan(v))
    total = lambda f: F.sum(F.aggregate("_v", F.lit(0.0), lambda a, v: a + f(v)))
    held = refits.join(blocks, KEY).where("at < end").select(KEY, "refit", "end", seen.alias("_v"))
    moment = held.groupBy(KEY, "refit", "end").agg(F.sum(F.size("_v")).alias("n"), total(lambda v: v).alias("s1"), total(lambda v: v * v).alias("s2")).where(F.col("n") >= 10 * k)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for symbol, refit, end, n, s1, s2 in b.itertuples(index=False):
                m = begun(s1 / n, max(s2 / n - (s1 / n) ** 2, 0.0) ** 0.5, s).packed()
                yield pd.DataFrame({KEY: symbol, "refit": refit, "start": range(len(m)), "end": end, "p": m.tolist(), "ll": -np.inf, "open": True})

    fit = f"{KEY} {kind}, refit long, start int, end long, p array<double>, ll double, open boolean"
    models = kept(moment.select(KEY, "refit", "end", "n", "s1", "s2").mapInPandas(start, fit), "models")

    def jobs(models: DataFrame, more: list[str]) -> DataFrame:
        """Blocks with the models that see them, TOGETHER refits at a time."""
        on = [KEY, "blk"] if "blk" in models.columns else [KEY]
        held = models.groupBy(*on, F.floor(F.col("refit") / TOGETHER).alias("_g")).agg(F.collect_list(F.struct("refit", "start", "end", "p", *more)).alias("models"), F.max("end").alias("_most"))
        return held.join(blocks, on).where("at < _most").select(KEY, "blk", "at", "x", "models")

    def matrices(x, ends, held, row) -> pd.DataFrame:
        """Where each state leads over the block: by sums, and by the likeliest path."""
        m = unpack(held)
        each = m.take(np.repeat(np.arange(len(held)), k))
        v, ll = matrices_of(x, ends, m)
        best, _ = likeliest(x, np.repeat(ends, k), each, np.tile(np.where(np.eye(k) > 0, 0.0, -1e290), (len(held), 1)))
        flat = lambda a: a.reshape(len(held), -1).tolist()
        return pd.DataFrame({KEY: row[0], "refit": [h["refit"] for h in held], "start": [h["start"] for h in held], "blk": row[1], "n": ends, "v": flat(v), "scale": flat(ll), "best": flat(best)})

    step = f"{KEY} {kind}, refit long, start int, blk long, n long, v array<double>, scale array<double>, best array<double>"

    def chained(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        """For each block of one model what comes before and after it."""
        g = g.sort_values("blk").reset_index(drop=True)
        m = Models.unpacked(np.array(h["p"].tolist()), k)
        v, best, out, ll = m.start[0], np.log(np.maximum(m.start[0], _TINY)), [], 0.0
        mats, scales, bests = (np.array(g[c].tolist(), dtype=float).reshape(len(g), 1, *shape) for c, shape in (("v", (k, k)), ("scale", (k,)), ("best", (k, k))))
        for a, c, z in zip(mats, scales, bests, strict=True):
            out.append([v, best, ll])
            w, more = joined(v[None], a, c)
            v, ll, best = w[0], ll + more[0], (best[:, None] + z[0]).max(axis=0)
        u = np.ones(k)
        for i in range(len(mats) - 1, -1, -1):
            out[i].append(u)
            u = joined_back(u[None], mats[i], scales[i])[0]
        later = g["n"][::-1].cumsum()[::-1] - g["n"]
        row = h.iloc[0]
        return pd.DataFrame({KEY: row[KEY], "refit": row["refit"], "start": row["start"], "end": row["end"], "blk": g["blk"], "p": [row["p"]] * len(g), "head": g.index == 0, "more": later > 0, "from": [o[0].tolist() for o in out], "best": [o[1].tolist() for o in out], "ll": [o[2] for o in out], "to": [o[3].tolist() for o in out]})

    chain = f"{KEY} {kind}, refit long, start int, end long, blk long, p array<double>, head boolean, more boolean, from array<double>, best array<double>, ll double, to array<double>"
    by = [KEY, "refit", "start"]

    def along(models: DataFrame) -> DataFrame:
        found = _per_block(jobs(models, []), matrices, step).where("n > 0")
        return kept(found.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(chained, chain), "chains")

    def summed(x, ends, held, row) -> pd.DataFrame:
        m = unpack(held)
        get = lambda c: np.array([h[c] for h in held], dtype=float)
        got, ll = stretched_sums(x, ends, np.array([h["more"] for h in held]), m, get("from"), get("to"))
        return pd.DataFrame({KEY: row[0], "refit": [h["refit"] for h in held], "start": [h["start"] for h in held], "first": [h["head"] for h in held], "s": got.tolist(), "scale": ll})

    def renewed(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        row = h.iloc[0]
        parts = np.array(g["s"].tolist())
        total = parts.sum(axis=0)
        total[:k] = parts[g["first"].to_numpy()][0][:k]  # only the first block has the first row
        ll = float(g["scale"].sum())
        return pd.DataFrame({KEY: [row[KEY]], "refit": row["refit"], "start": row["start"], "end": row["end"], "p": [maximised(total[None], k, s.scatter).packed()[0].tolist()], "ll": ll, "open": bool(ll - row["ll"] >= s.tol)})

    done = None
    for _ in range(s.max_iter):
        found = _per_block(jobs(along(models), ["head", "more", "from", "to"]), summed, f"{KEY} {kind}, refit long, start int, first boolean, s array<double>, scale double")
        models = kept(found.groupBy(*by).cogroup(models.groupBy(*by)).applyInPandas(renewed, fit), "models")
        ready = models.where("not open")
        done = ready if done is None else done.unionByName(ready)
        models = models.where("open")
        if models.isEmpty():
            break
    models = kept(done.unionByName(models), "models")

    def last(x, ends, held, row) -> pd.DataFrame:
        m = unpack(held)
        get = lambda c: np.array([h[c] for h in held], dtype=float)
        _, ll, probs, *_ = forward(x, ends, m, get("from"))
        _, state = likeliest(x, ends, m, get("best"))
        order = np.argsort(m.var, axis=1, kind="stable")
        rank = np.argsort(order, axis=1)
        at = np.arange(len(held))
        return pd.DataFrame({KEY: row[0], "refit": [h["refit"] for h in held], "start": [h["start"] for h in held], "p": m.ordered().packed().tolist(), "ll": get("ll") + ll, "state": rank[at, state], "probs": probs[at[:, None], order].tolist()})

    ends = _per_block(jobs(along(models).where("not more"), ["from", "best", "ll"]), last, f"{KEY} {kind}, {_FIT}")
    rank = F.row_number().over(W.partitionBy(KEY, "refit").orderBy(F.desc("ll"), "start"))
    return ends.withColumn("_r", rank).where("_r = 1").drop("_r")


def regimes(df: DataFrame, s: Settings | None = None) -> DataFrame:
    """symbol, datetime, hmm_regime and prob_state_0.. of the bar before, from the closes up to it."""
    s = s or Settings()
    kind, k = dict(df.dtypes)[KEY], s.states
    placed = kept(indexed(df.select(KEY, TIME, F.col("close").cast("double").alias("close"))), "bars")
    r = Rolling.of_blocks()
    obs = blocked(placed, 1).select(KEY, INDEX, returns(F.col("close"), r).alias("x"), "_core").where("_core").drop("_core")
    obs = kept(obs.withColumn("x", F.coalesce("x", F.lit(float("nan")))), "observations")
    blk = F.floor(F.col(INDEX) / s.block)
    grouped = obs.groupBy(KEY, blk.alias("blk")).agg(F.array_sort(F.collect_list(F.struct(INDEX, "x"))).alias("_r"))
    blocks = kept(grouped.select(KEY, "blk", (F.col("blk") * s.block).alias("at"), F.col("_r.x").alias("x")), "blocks")
    sizes = obs.groupBy(KEY).agg(F.max(INDEX).alias("_top")).where(F.col("_top") >= s.first)
    refits = sizes.select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_top") - s.first) / s.every).cast("long"))).alias("refit"))
    refits = refits.withColumn("end", F.col("refit") * s.every + s.first + 1)  # rows seen
    short, long_ = refits.where(F.col("end") <= s.block), refits.where(F.col("end") > s.block)
    models = _short(short, blocks, s, kind)
    if not long_.isEmpty():
        models = models.unionByName(_long(long_, blocks, s, kind))
    models = kept(models, "models")

    def between(_, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        """Bars up to the next refit: the model from its start over the last rows."""
        if not len(model) or not len(rows):
            return pd.DataFrame({KEY: pd.Series(dtype=object), INDEX: pd.Series(dtype="int64"), "state": pd.Series(dtype="int32"), "probs": pd.Series(dtype=object)})
        rows = rows.sort_values(INDEX)
        at, x = rows[INDEX].to_numpy(), rows["x"].to_numpy()
        begin = int(model["refit"].iloc[0]) * s.every + s.first
        bars = at[at > begin]
        m = Models.unpacked(np.array(model["p"].tolist()), k).take(np.zeros(len(bars), dtype=int))
        wide, ends = np.zeros((s.lookback + 1, len(bars))), np.zeros(len(bars), dtype=int)
        for j, i in enumerate(bars):
            seen = _known(x[(at >= i - s.lookback) & (at <= i)])
            wide[: len(seen), j], ends[j] = seen, len(seen)
        _, _, probs, *_ = forward(wide, ends, m, m.start)
        _, state = likeliest(wide, ends, m, np.log(np.maximum(m.start, _TINY)))
        ok = ends >= k
        return pd.DataFrame({KEY: rows[KEY].iloc[0], INDEX: bars[ok], "state": state[ok], "probs": pd.Series(list(probs[ok]), dtype=object)})

    lo = F.greatest(F.ceil((F.col(INDEX) - s.every + 1 - s.first) / s.every).cast("long"), F.lit(0).cast("long"))
    hi = F.floor((F.col(INDEX) - 1 + s.lookback - s.first) / s.every).cast("long")
    needed = obs.withColumn("refit", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    schema = f"{KEY} {kind}, {INDEX} long, state int, probs array<double>"
    dealt = lambda x: x.repartition(_tasks(df), KEY, "refit").groupBy(KEY, "refit")
    rest = dealt(needed).cogroup(dealt(models)).applyInPandas(between, schema)
    own = models.select(KEY, (F.col("refit") * s.every + s.first).alias(INDEX), "state", "probs")
    found = own.unionByName(rest).withColumn(INDEX, F.col(INDEX) + 1)
    label = F.get(F.array(*map(F.lit, s.labels)), F.col("state"))
    out = placed.join(found, [KEY, INDEX], "left")
    return out.select(KEY, TIME, label.alias("hmm_regime"), *[F.get("probs", F.lit(i)).alias(f"prob_state_{i}") for i in range(k)])
