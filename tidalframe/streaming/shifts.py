"""Mean-shift detectors and alerts over streams: keyed state, restarted from the stream's checkpoint.

Rows of one name are taken in the order of time within a micro-batch; a name's state has a size that does not grow with the stream
(ADWIN's grows with its logarithm).  Defined cases: a null or NaN value is passed over; rows of one time are in order of value; a row
without a name has a state of its own; equal rows count again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Severities in order, and the relative changes of the mean where the next one begins.
SEVERITIES = ("none", "low", "medium", "high", "critical")
CHANGES = (0.05, 0.15, 0.30)

SHIFT = "name string, datetime timestamp, metric double, previous double, width long, severity string"


def severity(before: float, now: float) -> str:
    change = abs(now) if abs(before) < 1e-8 else abs(now - before) / abs(before)
    return SEVERITIES[1 + sum(change >= c for c in CHANGES)]


class Window:
    """ADWIN's window: rows of at most `most` buckets of 2^row values each, newest first, as (sum, sum of squared deviations)."""

    def __init__(self, delta: float, most: int = 5, every: int = 32, least: int = 5, grace: int = 10):
        self.delta, self.most, self.every, self.least, self.grace = delta, most, every, least, grace
        self.rows: list[list[tuple[float, float]]] = []
        self.n, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0

    @property
    def mean(self) -> float:
        return self.total / self.n if self.n else 0.0

    def packed(self) -> tuple:
        flat = [(i, *b) for i, row in enumerate(self.rows) for b in row]
        level, sums, spreads = (list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [])
        return level, sums, spreads, self.n, self.total, self.spread, self.ticks

    def unpack(self, level, sums, spreads, n, total, spread, ticks) -> Window:
        self.rows = [[] for _ in range(max(level, default=-1) + 1)]
        for i, *b in zip(level, sums, spreads, strict=True):
            self.rows[i].append(tuple(b))
        self.n, self.total, self.spread, self.ticks = n, total, spread, ticks
        return self

    def add(self, x: float) -> bool:
        """Whether the window was cut after x."""
        if self.n:
            self.spread += self.n * (x - self.mean) ** 2 / (self.n + 1)
        self.n, self.total, self.ticks = self.n + 1, self.total + x, self.ticks + 1
        carry, i = (x, 0.0), 0
        while carry is not None:
            if i == len(self.rows):
                self.rows.append([])
            self.rows[i].insert(0, carry)
            carry = None
            if len(self.rows[i]) > self.most:
                (a, va), (b, vb) = self.rows[i].pop(), self.rows[i].pop()
                size = 1 << i
                carry = (a + b, va + vb + (a - b) ** 2 / (2 * size))
            i += 1
        return self.ticks % self.every == 0 and self.n > self.grace and self._cut()

    def _cut(self) -> bool:
        cut, again = False, True
        while again:
            again = False
            n0, u0 = 0, 0.0
            log = math.log(2 * math.log(self.n) / self.delta)
            for i in range(len(self.rows) - 1, -1, -1):
                for s, _ in reversed(self.rows[i]):
                    n0, u0 = n0 + (1 << i), u0 + s
                    n1 = self.n - n0
                    if n0 < self.least or n1 < self.least:
                        continue
                    share = 1 / (n0 - self.least + 1) + 1 / (n1 - self.least + 1)
                    bound = math.sqrt(2 * share * self.spread / self.n * log) + 2 / 3 * share * log
                    if abs(u0 / n0 - (self.total - u0) / n1) > bound:
                        cut = again = True
                        break
                if again:
                    break
            if again:
                self._drop()
        return cut

    def _drop(self) -> None:
        """The oldest bucket goes."""
        size, (s, v) = 1 << (len(self.rows) - 1), self.rows[-1].pop()
        if not self.rows[-1]:
            self.rows.pop()
        left = self.n - size
        rest = (self.total - s) / left if left else 0.0
        self.spread = max(self.spread - v - size * left * (s / size - rest) ** 2 / self.n, 0.0)
        self.n, self.total = left, self.total - s


def beta_ratio(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1, 5000):
        m = i // 2
        t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or 1e-300)
        c = (1 + t / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front / f


def t_test(a: list[float], b: list[float]) -> float:
    """The two-sided p value of Student's test of equal means, variances pooled."""
    n, m = len(a), len(b)
    x, y = sum(a) / n, sum(b) / m
    s = (sum((v - x) ** 2 for v in a) + sum((v - y) ** 2 for v in b)) / (n + m - 2)
    if s == 0:
        return 1.0 if x == y else 0.0
    t2 = (x - y) ** 2 / (s * (1 / n + 1 / m))
    return beta_ratio((n + m - 2) / 2, 0.5, (n + m - 2) / (n + m - 2 + t2))


class _Processor(StatefulProcessor):
    """rows: names of what is read beside the time; step(state or None, time, row) gives (new state, a result or None)."""

    def __init__(self, schema: str, columns: list[str], step: Callable, out: list[str]):
        self.schema, self.columns, self.step, self.out = schema, columns, step, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["datetime", *self.columns]] for r in rows]).sort_values(["datetime", *self.columns[:1]], kind="stable")
        state, made = self.state.get() if self.state.exists() else None, []
        for t, *row in batch.itertuples(index=False, name=None):
            state, found = self.step(state, t, row)
            if found is not None:
                made.append((key[0], t, *found))
        if state is not None:
            self.state.update(state)
        yield pd.DataFrame(made, columns=["name", "datetime", *self.out]).astype({"datetime": "datetime64[us]"})

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(df: DataFrame, processor: _Processor, schema: str) -> DataFrame:
    """Streams and tables alike; such state needs a store with column families, which is set if the session has another."""
    conf = df.sparkSession.conf
    if "RocksDB" not in (conf.get(_PROVIDER, "") or ""):
        conf.set(_PROVIDER, _ROCKS)
    _ = df.sparkSession.streams.active  # starts the coordinator of state stores, which a table's query needs too
    mode, time = ("EventTime", "datetime") if df.isStreaming else ("None", "")
    return df.groupBy("name").transformWithStateInPandas(processor, schema, "Append", mode, eventTimeColumnName=time)


def adwin(values: DataFrame, delta: float = 0.002, least: int = 30, late: str = "1 minute") -> DataFrame:
    """SHIFT rows of a stream of name, datetime, x where an adaptive window drops its older part; the first `least` values report nothing."""

    def step(state, t, row):
        x = row[0]
        if x is None or x != x:
            return state, None
        w, seen, before = Window(delta), 0, None
        if state is not None:
            *packed, seen, before = state
            w.unpack(*packed)
        cut = w.add(float(x))
        found = None
        if cut and seen + 1 >= least:
            before = w.mean if before is None else before
            found = (w.mean, before, w.n, severity(before, w.mean))
        return (*w.packed(), seen + 1, w.mean), found

    state = "level array<int>, sums array<double>, spreads array<double>, n long, total double, spread double, ticks long, seen long, before double"
    return _stateful(values.withWatermark("datetime", late), _Processor(state, ["x"], step, ["metric", "previous", "width", "severity"]), SHIFT)


def halves(values: DataFrame, delta: float = 0.002, least: int = 30, most: int = 1000, late: str = "1 minute") -> DataFrame:
    """SHIFT rows where a t-test tells the halves of the last `most` values apart; every value is tested once there are 2 * least."""

    def step(state, t, row):
        x = row[0]
        if x is None or x != x:
            return state, None
        held = [*(state[0] if state is not None else []), float(x)][-most:]
        found = None
        if len(held) >= 2 * least:
            a, b = held[: len(held) // 2], held[len(held) // 2 :]
            if t_test(a, b) < delta:
                before, now = sum(a) / len(a), sum(b) / len(b)
                found = (now, before, len(held), severity(before, now))
        return (held,), found

    return _stateful(values.withWatermark("datetime", late), _Processor("held array<double>", ["x"], step, ["metric", "previous", "width", "severity"]), SHIFT)


ALERT = "name string, datetime timestamp, severity string, metric double"


def alerts(found: DataFrame, least: str = "low", every: float = 60.0, late: str = "1 minute") -> DataFrame:
    """ALERT rows of a stream of name, datetime, severity, metric: those of a severity of `least` or more, `every` seconds after the name's last alert or later.

    A row that is earlier than its name's last alert gives none; rows behind the watermark are dropped.
    """
    rank = {s: i for i, s in enumerate(SEVERITIES)}

    def step(state, t, row):
        kind, metric = row
        if t is pd.NaT or rank.get(kind, 0) < rank[least]:
            return state, None
        at = t.timestamp()
        if state is not None and at - state[0] < every:
            return state, None
        return (at,), (kind, metric)

    marked = found.select("name", "datetime", "severity", "metric").withWatermark("datetime", late)
    return _stateful(marked, _Processor("last double", ["severity", "metric"], step, ["severity", "metric"]), ALERT)


def digests(alerted: DataFrame, window: str = "300 seconds") -> DataFrame:
    """Per window of alerts (a stream with a watermark): start, n_alerts, n_features, max_severity, and n and the largest metric by name."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    by_name = alerted.groupBy(F.window("datetime", window), "name").agg(F.count(F.lit(1)).alias("n"), F.max("metric").alias("most"), F.max(rank).alias("rank"))
    whole = by_name.groupBy("window").agg(
        F.sum("n").alias("n_alerts"), F.count(F.lit(1)).alias("n_features"), F.max("rank").alias("rank"),
        F.collect_list(F.struct("name", "n", "most")).alias("features"),
    )
    return whole.select(F.col("window.start").alias("start"), "n_alerts", "n_features", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank") - 1).alias("max_severity"), F.array_sort("features").alias("features"))
