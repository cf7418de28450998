"""Exact quantiles of groups of any size.

An exact percentile as one aggregate holds all different values of a group in one task.
Here a sketch of bounded size, whose ranks are off by one in ACCURACY at most, gives an
interval for each quantile; then values inside the interval are counted one by one and those
below it as one number.  Both steps combine before they shuffle, and what is sorted is about
8 / ACCURACY of a group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept

#: Of the sketch; a group with fewer rows is counted value by value.
ACCURACY = 10_000
_INF = float("inf")


def quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float], out: str = "q", stored: bool = False) -> DataFrame:
    """keys and out, an array of the exact quantiles at probs, linear between ranks; NaN is the largest value.

    Nulls do not count; a group of nulls alone has no row.  A null key is a group of its own.
    The column is read twice: stored writes it, with its keys, to the shared scratch folder first, for one that is dear to make.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    x = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.col(column).cast("double").alias("_x")).where("_x is not null")
    if stored:
        x = kept(x, "quantiles")
    x = x.withColumn("_y", F.when(F.isnan("_x"), _INF).otherwise(F.col("_x")))
    n, slack = len(probs), 4 / ACCURACY
    ends = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    sketch = x.groupBy(*ks).agg(F.count(F.lit(1)).alias("_all"), F.percentile_approx("_y", ends, ACCURACY).alias("_ends"))
    small = F.col("_all") <= ACCURACY
    end = lambda i, p, edge, open_: F.when(small | F.lit(edge(p)), open_).otherwise(F.col("_ends")[i])
    spans = [F.struct(end(i, p, lambda p: p <= slack, -_INF).alias("lo"), end(n + i, p, lambda p: p >= 1 - slack, _INF).alias("hi")) for i, p in enumerate(probs)]
    sketch = renamed(sketch.select(*ks, "_all", F.array(*spans).alias("_spans")), ks)

    each = F.transform("_spans", lambda s, i: F.when(F.col("_y") <= s["hi"], F.struct(i.alias("i"), F.when(F.col("_y") >= s["lo"], F.col("_x")).alias("v"))))
    rows = x.join(sketch, same(ks)).select(*ks, "_all", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("_e"))
    near = rows.groupBy(*ks, "_all", "_e.i", "_e.v").agg(F.count(F.lit(1)).alias("_n"))
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("_all") - 1)
    upto = F.sum("_n").over(W.partitionBy(*ks, "i").orderBy("v"))  # values below the interval come first, as null
    near = near.withColumns({"_to": upto, "_p": place})
    holds = lambda r: (F.col("_to") - F.col("_n") <= r) & (r < F.col("_to"))
    hits = near.where(holds(F.floor("_p")) | holds(F.ceil("_p")))
    at = lambda i, r: F.max(F.when((F.col("i") == i) & holds(r(F.col("_p"))), F.col("v")))
    got = hits.groupBy(*ks, "_all").agg(*[at(i, r).alias(f"_{side}{i}") for i in range(n) for side, r in (("a", F.floor), ("b", F.ceil))])

    def value(i: int) -> Column:
        p, a, b = F.lit(float(probs[i])) * (F.col("_all") - 1), F.col(f"_a{i}"), F.col(f"_b{i}")
        line = F.when(a.eqNullSafe(b), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)
        return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a quantile lies outside of its interval")).cast("double")).otherwise(line)

    return got.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], F.array(*map(value, range(n))).alias(out))


def with_quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float], out: str = "_q", only: Column | None = None, stored: bool = False) -> DataFrame:
    """df with out, the quantiles of its row's group (of the rows where `only` holds); null where the group has none."""
    q = quantiles(df if only is None else df.where(only), keys, column, probs, out, stored)
    return df.join(renamed(q, keys), same(keys), "left").drop(*[f"_of_{k}" for k in keys])


def renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return on
