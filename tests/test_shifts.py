"""Mean-shift streams: ADWIN against sums over the raw values, the t-test against tables, restarts, alerts with late rows."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe import plans
from tidalframe.streaming import shifts


def plain_adwin(values, delta, most=5, every=32, least=5, grace=10):
    """Indexes after which the window was cut; buckets are sizes over a list of all values of the window."""
    held, sizes, out = [], [], []  # sizes oldest first
    for i, x in enumerate(values):
        held.append(x)
        sizes.append(1)
        size = 1
        while sizes.count(size) > most:
            at = sizes.index(size)
            sizes[at : at + 2] = [2 * size]
            size *= 2
        if (i + 1) % every or len(held) <= grace:
            continue
        cut, again = False, True
        while again:
            again = False
            n = len(held)
            log = math.log(2 * math.log(n) / delta)
            n0 = 0
            for size in sizes:
                n0 += size
                n1 = n - n0
                if n0 < least or n1 < least:
                    continue
                share = 1 / (n0 - least + 1) + 1 / (n1 - least + 1)
                if abs(np.mean(held[:n0]) - np.mean(held[n0:])) > math.sqrt(2 * share * np.var(held) * log) + 2 / 3 * share * log:
                    again = cut = True
                    held, sizes = held[sizes[0] :], sizes[1:]
                    break
        if cut:
            out.append((i, len(held), np.mean(held)))
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.0, 0.4, 3.0]))
def test_adwin_cuts_where_the_plain_version_does(seed, jump):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=900) + np.where(np.arange(900) > 500, jump, 0.0)
    w, got = shifts.Window(0.01), []
    for i, v in enumerate(x):
        if w.add(v):
            got.append((i, w.n, w.mean))
        if i % 100 == 0:  # state survives being packed
            w = shifts.Window(0.01).unpack(*w.packed())
    want = plain_adwin(x, 0.01)
    assert [g[:2] for g in got] == [p[:2] for p in want] and np.allclose([g[2] for g in got], [p[2] for p in want])
    assert jump < 3 or got


def test_t_test_values():
    # Two-sided points of Student's t at 10 and 2 degrees of freedom, and at 998 that of the normal law but for a thousandth.
    for df, t, p in ((10, 2.228139, 0.05), (10, 3.169273, 0.01), (2, 4.302653, 0.05), (998, 1.962344, 0.05)):
        assert shifts.beta_ratio(df / 2, 0.5, df / (df + t * t)) == pytest.approx(p, rel=1e-5)
    assert shifts.t_test([1.0, 1.0], [1.0, 1.0]) == 1.0 and shifts.t_test([1.0, 1.0], [2.0, 2.0]) == 0.0
    assert shifts.t_test([1.0, 2.0, 3.0], [2.0, 3.0, 4.0]) == pytest.approx(0.2878641, rel=1e-5)  # t = 1.2247, 4 degrees


def test_severities():
    assert [shifts.severity(1.0, x) for x in (1.01, 1.1, 1.2, 1.3)] == ["low", "medium", "high", "critical"]
    assert shifts.severity(0.0, 0.04) == "low" and shifts.severity(-2.0, 2.0) == "critical"


def ran(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q


def frame(spark, rows, columns):
    start = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(n, (start + pd.Timedelta(seconds=s)).to_pydatetime(), *rest) for n, s, *rest in rows], columns)


def test_adwin_stream_survives_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {n: rng.normal(size=600) + np.where(np.arange(600) > 350, 4.0 if n == "a" else 0.0, 0.0) for n in ("a", "b")}
    rows = [(n, i, float(v)) for n, xs in x.items() for i, v in enumerate(xs)] + [("a", 10, None), ("b", 599, float("nan"))]
    df = frame(spark, rows, "name string, datetime timestamp, x double")
    src, out, check = (f"{tmp_path}/{d}" for d in ("in", "out", "check"))
    for lo, hi in ((0, 200), (200, 380), (380, 600)):  # each a run of its own, from the checkpoint of the one before
        s = F.unix_seconds("datetime") - 1704067200
        df.where((s >= lo) & (s < hi)).coalesce(1).write.mode("append").parquet(src)
        ran(shifts.adwin(spark.readStream.schema(df.schema).parquet(src), 0.01), out, check)
    got = spark.read.parquet(out).toPandas().sort_values("datetime")
    want = [p for p in plain_adwin(x["a"], 0.01) if p[0] + 1 >= 30]
    assert want and set(got.name) == {"a"} and list((got.datetime - pd.Timestamp("2024-01-01")).dt.total_seconds()) == [p[0] for p in want]
    assert list(got.width) == [p[1] for p in want] and np.allclose(got.metric, [p[2] for p in want]) and set(got.severity) == {"critical"}


def test_halves_stream(spark, tmp_path):
    x = [float(i % 5) + (3.0 if i >= 80 else 0.0) for i in range(120)]
    df = frame(spark, [("a", i, v) for i, v in enumerate(x)], "name string, datetime timestamp, x double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    ran(shifts.halves(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 0.002, 30, 100), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    want = [i for i in range(59, 120) if (h := x[max(0, i - 99) : i + 1]) and shifts.t_test(h[: len(h) // 2], h[len(h) // 2 :]) < 0.002]
    assert sorted((got.datetime - pd.Timestamp("2024-01-01")).dt.total_seconds()) == want and want


def test_alerts_gate_limit_and_windows(spark, tmp_path):
    rows = [("a", 0, "high", 1.0), ("a", 30, "critical", 2.0), ("a", 59, "high", 9.0), ("a", 60, "medium", 3.0), ("a", 61, "high", 4.0), ("b", 10, "low", 5.0), ("b", 20, "medium", 6.0), ("c", 290, "high", 7.0)]
    later = [("a", 310, "high", 8.0), ("a", 5, "critical", 99.0), ("b", 320, "critical", 1.0), ("z", 4000, "high", 0.0)]
    columns = "name string, datetime timestamp, severity string, metric double"
    df = frame(spark, rows, columns)
    src, out, check = (f"{tmp_path}/{d}" for d in ("in", "out", "check"))
    stream = lambda: shifts.digests(shifts.alerts(spark.readStream.schema(df.schema).parquet(src), "medium"))
    df.coalesce(1).write.parquet(src)
    ran(stream(), out, check)
    frame(spark, later, columns).coalesce(1).write.mode("append").parquet(src)
    ran(stream(), out, check)
    frame(spark, [("z", 9000, "high", 0.0)], columns).coalesce(1).write.mode("append").parquet(src)
    ran(stream(), out, check)
    got = {(r.start - pd.Timestamp("2024-01-01")).total_seconds(): (r.n_alerts, r.n_features, r.max_severity, [tuple(f) for f in r.features]) for r in spark.read.parquet(out).collect()}
    assert got[0.0] == (4, 3, "high", [("a", 2, 3.0), ("b", 1, 6.0), ("c", 1, 7.0)])
    assert got[300.0] == (2, 2, "critical", [("a", 1, 8.0), ("b", 1, 1.0)])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_adwin_query_equals_the_plain_version(spark, sf, size):
    d = os.path.join(os.path.dirname(sf), size)
    rows = plans.QUERIES["adwin_shifts"](spark, d).collect()
    values = {}
    for name, _, x in sorted(r for r in spark.read.parquet(f"{d}/events.parquet").select("event_type", "ts", "value").collect() if r[2] is not None):
        values.setdefault(name, []).append(x)
    want = sorted((name, p[1], p[2]) for name, x in values.items() for p in plain_adwin(x, 0.3) if p[0] + 1 >= 30)
    got = sorted((r.name, r.width, r.metric) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want])
