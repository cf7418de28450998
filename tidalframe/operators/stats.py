"""Scaling, selection, drift, calibration and evaluation as aggregates over tables."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..quantiles import quantiles, renamed, same

CLIP = 5.0
#: Columns of one aggregate; more columns take several.
WIDTH = 200


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_e")).select(*keep, "_e.*")


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "robust", logs: tuple[str, ...] = ()) -> DataFrame:
    """name, fill, shift (null: no logarithm), center, scale of each column: medians and quartiles or moments after filling and log1p."""
    x = unpivot(df, columns).withColumn("x", _finite(F.col("x")))
    p = _joined(x.groupBy("name").agg(F.min("x").alias("lo")), quantiles(x, ["name"], "x", [0.5])).withColumn("fill", F.coalesce(F.col("q")[0], F.lit(0.0)))
    shift = F.when(F.col("name").isin(*logs), F.when(F.col("lo") <= 0, F.abs("lo") + 1).otherwise(0.0)) if logs else F.lit(None).cast("double")
    p = p.select("name", "fill", shift.alias("shift"))
    y = x.join(F.broadcast(p), "name").withColumn("y", _logged(F.coalesce("x", "fill")))  # a row a column
    if kind == "robust":
        q = F.col("q")
        out = _joined(p, quantiles(y, ["name"], "y", [0.25, 0.5, 0.75])).select("name", "fill", "shift", q[1].alias("center"), (q[2] - q[0]).alias("scale"))
    else:
        center = {"standard": F.avg("y"), "minmax": F.min("y"), "none": F.lit(0.0)}[kind]
        scale = {"standard": F.stddev_pop("y"), "minmax": F.max("y") - F.min("y"), "none": F.lit(1.0)}[kind]
        out = y.groupBy("name", "fill", "shift").agg(center.alias("center"), scale.alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def _joined(s: DataFrame, q: DataFrame) -> DataFrame:
    """s with q by name; a column without values has none."""
    return s.join(renamed(q, ["name"]), same(["name"]), "left").drop("_of_name")


def _logged(x: Column) -> Column:
    return F.when(F.col("shift").isNull(), x).otherwise(F.log1p(x + F.col("shift")))


def transform(df: DataFrame, scaler: DataFrame, clip: float = CLIP) -> DataFrame:
    """df with each column of the scaler filled, scaled and clipped."""
    out = {}
    for r in scaler.collect():  # a row a column
        x = F.coalesce(_finite(F.col(r["name"]).cast("double")), F.lit(r["fill"]))
        y = x if r["shift"] is None else F.log1p(x + r["shift"])
        out[r["name"]] = F.greatest(F.least((y - r["center"]) / r["scale"], F.lit(clip)), F.lit(-clip))
    return df.withColumns(out)


def inverse(df: DataFrame, scaler: DataFrame) -> DataFrame:
    out = {}
    for r in scaler.collect():
        y = F.col(r["name"]) * r["scale"] + r["center"]
        out[r["name"]] = y if r["shift"] is None else F.expm1(y) - r["shift"]
    return df.withColumns(out)


def low_variance(df: DataFrame, columns: list[str], threshold: float = 1e-4) -> DataFrame:
    """name, variance, relative, drop: both the variance and variance over squared mean are under the threshold."""
    s = unpivot(df, columns).groupBy("name").agg(F.var_samp("x").alias("variance"), F.avg("x").alias("mean"), F.count("x").alias("n"))
    rel = F.col("variance") / F.nullif(F.pow("mean", F.lit(2)), F.lit(0.0))
    return s.select("name", "variance", rel.alias("relative"), ((F.col("n") >= 100) & (F.col("variance") < threshold) & (F.coalesce(rel, F.lit(0.0)) < threshold)).alias("drop"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of every pair of columns, in aggregates over the rows; missing counts as 0."""
    x = {c: F.coalesce(_finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns}
    pairs = list(combinations(sorted(columns), 2))
    out = None
    for lo in range(0, len(pairs), WIDTH):
        part = pairs[lo : lo + WIDTH]
        one = df.agg(*[F.corr(x[a], x[b]).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(part)])).alias("e")).select("e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def correlated_groups(df: DataFrame, columns: list[str], threshold: float = 0.85, priority: dict[str, int] | None = None) -> dict[str, list[str]]:
    """The column kept of each group of correlated ones (highest priority, then name) and the others."""
    parent = {c: c for c in columns}

    def find(c: str) -> str:
        while parent[c] != c:
            c = parent[c]
        return c

    for r in correlations(df, columns).where(F.abs("corr") >= threshold).collect():  # pairs of columns
        parent[find(r["a"])] = find(r["b"])
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(find(c), []).append(c)
    out = {}
    for g in groups.values():
        best, *rest = sorted(g, key=lambda c: (-(priority or {}).get(c, 0), c))
        out[best] = rest
    return out


def normalisation_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    x = unpivot(df, columns)
    s = x.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurtosis"))
    z = F.abs((F.col("x") - F.col("mean")) / F.nullif("std", F.lit(0.0)))
    far = x.join(F.broadcast(s.select("name", "mean", "std")), "name").groupBy("name").agg(*[F.count_if(z > k).alias(f"z_over_{k}") for k in (3, 5, 10)])
    five = [F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p5", "p50", "p95", "p99"))]
    return _joined(s.join(far, "name"), quantiles(x, ["name"], "x", [0.01, 0.05, 0.5, 0.95, 0.99])).select(*s.columns, *five, *far.columns[1:])


def integrity(df: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """key, rows, duplicates and span of each key, and its missing and infinite values."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
    infinite = sum((F.count_if(F.abs(c) == float("inf")) for c in columns[1:]), F.count_if(F.abs(columns[0]) == float("inf")))
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("rows"), (n - F.count_distinct(time)).alias("duplicates"), missing.alias("missing"), infinite.alias("infinite"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def psi_quantile(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """name, psi over bins between the different quantiles of the expected values; values outside are left out; under 3 edges 0."""
    e, a = unpivot(expected, columns), unpivot(actual, columns)
    edges = quantiles(e, ["name"], "x", [i / bins for i in range(bins + 1)]).select("name", F.array_distinct(F.array_sort("q")).alias("edges"))
    return _psi(e, a, edges, 1e-6, clip=True)


def psi_width(expected: DataFrame, actual: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """name, psi over bins of equal width of the expected range."""
    e, a = unpivot(expected, columns), unpivot(actual, columns)
    width = (F.col("hi") - F.col("lo")) / bins
    edges = e.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("name", F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + width * i)).alias("edges"))
    return _psi(e, a, edges, 1e-10, clip=False)


def _psi(e: DataFrame, a: DataFrame, edges: DataFrame, eps: float, clip: bool) -> DataFrame:
    both = e.withColumn("w", F.lit(0)).unionByName(a.withColumn("w", F.lit(1))).join(F.broadcast(edges), "name")  # a row a column
    n = F.size("edges") - 1
    inside = (F.col("x") >= F.get("edges", F.lit(0))) & (F.col("x") <= F.get("edges", n))
    bin_ = F.least(F.size(F.filter("edges", lambda v: v <= F.col("x"))), n)
    per = both.withColumn("bin", F.when(inside, bin_)).groupBy("name", "edges", "bin").agg(*[F.count_if(F.col("w") == k).alias(f"n{k}") for k in (0, 1)])
    if clip:
        per = per.where("bin is not null")
    total = per.groupBy("name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    grid = edges.select("name", F.size("edges").alias("k"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin"))
    x = grid.join(per.drop("edges"), ["name", "bin"], "left").join(total, "name")
    share = lambda k: F.coalesce(f"n{k}", F.lit(0)) / F.nullif(f"t{k}", F.lit(0))
    p, q = (F.greatest(share(k), F.lit(eps)) if clip else share(k) + eps for k in (0, 1))
    term = (q - p) * F.ln(q / p)
    return x.groupBy("name").agg(F.sum(F.when(F.col("k") >= 3, term).otherwise(0.0)).alias("psi"))


def ks(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """name, statistic, n_a, n_b of the two-sample Kolmogorov-Smirnov test.

    Counts are summed by value first, so the running sums go over different values of a column.
    """
    x = unpivot(a, columns).withColumn("w", F.lit(0)).unionByName(unpivot(b, columns).withColumn("w", F.lit(1))).where("x is not null")
    v = x.groupBy("name", "x").agg(*[F.count_if(F.col("w") == k).alias(f"n{k}") for k in (0, 1)])
    t = v.groupBy("name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    run = W.partitionBy("name").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    v = v.withColumns({"c0": F.sum("n0").over(run), "c1": F.sum("n1").over(run)}).join(F.broadcast(t), "name")
    return v.groupBy("name", "t0", "t1").agg(F.max(F.abs(F.col("c0") / F.col("t0") - F.col("c1") / F.col("t1"))).alias("statistic")).select("name", "statistic", F.col("t0").alias("n_a"), F.col("t1").alias("n_b"))


def ks_p(statistic: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """The asymptotic p value."""
    n = n_a * n_b / (n_a + n_b)
    lam = (F.sqrt(n) + 0.12 + F.lit(0.11) / F.sqrt(n)) * statistic
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.pow(j * lam, 2) * -2.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)))


def confusion(df: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    """name (class), support, precision, recall, f1; the rows `macro` and `weighted` average them, `accuracy` has it as f1."""
    c = confusion(df, truth, pred)
    t = c.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("predicted"))
    m = t.join(p, "k", "full").select("k", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    pr, rc = F.coalesce(F.col("tp") / F.nullif("predicted", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    m = m.withColumns({"precision": pr, "recall": rc}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    each = m.select(F.col("k").cast("string").alias("name"), "support", "precision", "recall", "f1")
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    s = F.sum("support").alias("support")
    macro = m.agg(s, *[F.avg(x).alias(x) for x in ("precision", "recall", "f1")]).select(F.lit("macro").alias("name"), "*")
    weighted = m.agg(s, *[w(x).alias(x) for x in ("precision", "recall", "f1")]).select(F.lit("weighted").alias("name"), "*")
    null = F.lit(None).cast("double")
    acc = m.agg(s, (F.sum("tp") / F.sum("support")).alias("f1")).select(F.lit("accuracy").alias("name"), "support", null.alias("precision"), null.alias("recall"), "f1")
    return each.unionByName(macro).unionByName(weighted).unionByName(acc)


def streaks(df: DataFrame, truth: str, pred: str, key: str, order: list[str]) -> DataFrame:
    """The longest runs of right and wrong signals of each key (pred other than 0)."""
    w = W.partitionBy(key).orderBy(*order)
    s = df.where(F.col(pred) != 0).withColumn("win", (F.col(truth) == F.col(pred)).cast("int"))
    s = s.withColumn("run", F.row_number().over(w) - F.row_number().over(W.partitionBy(key, "win").orderBy(*order)))
    n = s.groupBy(key, "win", "run").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("win") == 1, F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("win") == 0, F.col("n"))), F.lit(0)).alias("max_losses"))


def trading(df: DataFrame, truth: str, pred: str, key: str) -> DataFrame:
    p, t = F.col(pred), F.col(truth)
    ret = F.when(p != 0, F.when(p == t, 1.0).otherwise(-1.0))
    n = F.count_if(p != 0)
    share = lambda cond, of: F.count_if(cond) / F.nullif(F.count_if(of), F.lit(0))
    return df.groupBy(key).agg(n.alias("signals"), F.count_if(p == 1).alias("longs"), F.count_if(p == -1).alias("shorts"), share((p != 0) & (p == t), p != 0).alias("win_rate"), share((p == 1) & (t == 1), p == 1).alias("long_accuracy"), share((p == -1) & (t == -1), p == -1).alias("short_accuracy"), (F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0))).alias("sharpe"))


def brier(df: DataFrame, truth: str, probs: list[str]) -> DataFrame:
    parts = sum((F.pow(F.col(p) - (F.col(truth) == k).cast("double"), 2) for k, p in enumerate(probs)), F.lit(0.0))
    return df.agg(F.avg(parts).alias("brier"))


def predicted(probs: list[str]) -> Column:
    """The first class of the highest probability."""
    a = F.array(*map(F.col, probs))
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def reliability(df: DataFrame, truth: str, probs: list[str], bins: int = 10) -> DataFrame:
    """bin (1 to bins; lower edge open), n, confidence, accuracy."""
    conf = F.greatest(*map(F.col, probs))
    b = df.withColumns({"_c": conf, "_ok": (predicted(probs) == F.col(truth)).cast("double")})
    b = b.withColumn("bin", F.greatest(F.ceil(F.col("_c") * bins), F.lit(1)).cast("int"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("confidence"), F.avg("_ok").alias("accuracy"))


def ece(df: DataFrame, truth: str, probs: list[str], bins: int = 10) -> DataFrame:
    r = reliability(df, truth, probs, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def _ranked(probs: list[str]) -> Column:
    """cls and cum of each class, the likeliest first: the sum of the probabilities up to it."""
    order = F.array_sort(F.array(*[F.struct((-F.col(p)).alias("p"), F.lit(i).alias("cls")) for i, p in enumerate(probs)]))
    upto = lambda i: F.aggregate(F.slice(order, F.lit(1), i + 1), F.lit(0.0), lambda a, e: a - e["p"])
    return F.transform(order, lambda e, i: F.struct(e["cls"].alias("cls"), upto(i).alias("cum")))


def conformal_score(truth: str, probs: list[str], method: str = "lac") -> Column:
    """1 - p of the true class ("lac", "naive"), or the sum of all that are at least as likely ("aps")."""
    if method == "aps":
        return F.get(F.filter(_ranked(probs), lambda e: e["cls"] == F.col(truth).cast("int")), F.lit(0))["cum"]
    return 1 - F.get(F.array(*map(F.col, probs)), F.col(truth).cast("int"))


def conformal_quantile(df: DataFrame, truth: str, probs: list[str], alpha: float = 0.1, method: str = "lac") -> DataFrame:
    """One row, q: the score of the true class at the level (1 - alpha)(1 + 1/n) of the calibration rows."""
    s = df.select(conformal_score(truth, probs, method).alias("s"))
    n = s.count()
    return quantiles(s, [], "s", [min(1.0, (1 - alpha) * (1 + 1 / max(n, 1)))]).select(F.col("q")[0].alias("q"))


def conformal_sets(df: DataFrame, q: DataFrame, probs: list[str], method: str = "lac") -> DataFrame:
    """df with classes: all whose score is at most q (for aps but for rounding), or the likeliest."""
    a = F.array(*map(F.col, probs))
    if method == "aps":
        inside = F.array_sort(F.transform(F.filter(_ranked(probs), lambda e, i: (i == 0) | (e["cum"] <= F.col("q") + 1e-12)), lambda e: e["cls"]))
    else:
        inside = F.filter(F.transform(a, lambda p, i: F.when(1 - p <= F.col("q"), i.cast("int"))), lambda i: i.isNotNull())
    out = df.crossJoin(F.broadcast(q))  # one row
    return out.withColumn("classes", F.when(F.size(inside) > 0, inside).otherwise(F.array(predicted(probs)))).drop("q")


def soft_vote(df: DataFrame, models: list[str], weights: list[float] | None = None, classes: int = 3) -> DataFrame:
    w = weights or [1.0] * len(models)
    total = sum(w)
    out = df.withColumns({f"p{k}": sum((F.col(f"{m}_p{k}") * x for m, x in zip(models, w, strict=True)), F.lit(0.0)) / total for k in range(classes)})
    return out.withColumn("vote", predicted([f"p{k}" for k in range(classes)]))


def hard_vote(df: DataFrame, models: list[str], classes: int = 3) -> DataFrame:
    preds = [predicted([f"{m}_p{k}" for k in range(classes)]) for m in models]
    counts = F.array(*[sum(((p == k).cast("int") for p in preds), F.lit(0)) for k in range(classes)])
    return df.withColumn("vote", (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))


def softmax(margins: list[str]) -> Column:
    top = F.greatest(*map(F.col, margins))
    e = [F.exp(F.col(m) - top) for m in margins]
    total = sum(e[1:], e[0])
    return F.array(*[x / total for x in e])


def sharpe(df: DataFrame, ret: str, key: str, periods: int = 252) -> DataFrame:
    s = F.stddev_samp(ret)
    return df.groupBy(key).agg(F.when(s < 1e-10, 0.0).otherwise(F.avg(ret) / s * math.sqrt(periods)).alias("sharpe"))


def stability(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """mean, std, cv, min, max of a metric over folds, and a grade by cv."""
    m, s = F.avg(metric), F.stddev_pop(metric)
    cv = s / F.nullif(F.abs(m), F.lit(0.0))
    grade = F.when(cv < 0.15, "excellent").when(cv < 0.25, "good").when(cv < 0.40, "moderate").when(cv < 0.60, "poor").otherwise("unstable")
    return df.groupBy(*by).agg(m.alias("mean"), s.alias("std"), cv.alias("cv"), F.min(metric).alias("min"), F.max(metric).alias("max"), grade.alias("grade"))
