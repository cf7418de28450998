"""Chronological splits, folds and sequences over one global order of rows.

Positions come from series.indexed() with one constant key, so no window holds the
whole table; folds are a small table joined by range, a row for each row and fold.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..quantiles import with_quantiles
from ..series import KEY, TIME, Rolling, blocked, indexed

PURGE, EMBARGO = 60, 1440


def positions(df: DataFrame) -> DataFrame:
    """df with row_id: the place of a row by time, then symbol."""
    out = indexed(df.withColumn("_all", F.lit(1)), "_all", TIME)
    return out.withColumnRenamed("_idx", "row_id").drop("_all")


def bounds(n: int, train: float = 0.70, val: float = 0.15, purge: int = PURGE, embargo: int = EMBARGO) -> dict[str, tuple[int, int]]:
    a, b = int(n * train), int(n * (train + val))
    out = {"train": (0, a - purge), "val": (a + embargo, b - purge), "test": (b + embargo, n)}
    if bad := [k for k, (lo, hi) in out.items() if hi <= lo]:
        raise ValueError(f"{n} rows leave nothing for {', '.join(bad)}")
    return out


def chronological(df: DataFrame, **options) -> DataFrame:
    """Rows of the three splits with row_id and split; purged and embargoed rows are left out."""
    p = positions(df)
    spans = bounds(df.count(), **options)
    split = F.lit(None).cast("string")
    for name, (lo, hi) in spans.items():
        split = F.when((F.col("row_id") >= lo) & (F.col("row_id") < hi), name).otherwise(split)
    return p.withColumn("split", split).where("split is not null")


def symbol_shares(split: DataFrame) -> DataFrame:
    n = split.groupBy("split", KEY).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("split")))


def label_shares(split: DataFrame, label: str, invalid: int = -99) -> DataFrame:
    n = split.where(F.col(label) != invalid).groupBy("split", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("split")))


def _roles(df: DataFrame, folds: list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]], label_end: str | None) -> DataFrame:
    """(row_id, fold, role) from test and train ranges; training rows whose label reaches into a test range's time go."""
    spark = df.sparkSession
    p = positions(df).select("row_id", TIME, *([label_end] if label_end else []))
    rows = [(f, r, lo, hi) for f, tests, trains in folds for r, spans in (("test", tests), ("train", trains)) for lo, hi in spans if hi > lo]
    table = spark.createDataFrame(rows, "fold int, role string, lo long, hi long")
    # As many rows as folds have ranges; each data row meets the ranges it lies in.
    out = p.join(F.broadcast(table), (F.col("row_id") >= F.col("lo")) & (F.col("row_id") < F.col("hi")))
    if label_end:
        test_rows = [(f, lo, hi) for f, tests, _ in folds for lo, hi in tests]
        edges = spark.createDataFrame(test_rows, "fold int, a long, b long")
        ends = p.join(F.broadcast(edges), (F.col("row_id") == F.col("a")) | (F.col("row_id") == F.col("b") - 1)).groupBy("fold", "a").agg(F.min(TIME).alias("t0"), F.max(TIME).alias("t1"))
        spans = ends.groupBy("fold").agg(F.collect_list(F.struct("t0", "t1")).alias("spans"))
        out = out.join(F.broadcast(spans), "fold")
        hit = F.exists("spans", lambda s: (F.col(label_end) >= s["t0"]) & (F.col(TIME) <= s["t1"]))
        out = out.where((F.col("role") == "test") | ~F.coalesce(hit, F.lit(False)))
    return out.select("row_id", "fold", "role").distinct()


def fold_ranges(n: int, k: int, purge: int, embargo: int) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]]:
    size = n // k
    out = []
    for f in range(k):
        lo, hi = f * size, n if f == k - 1 else (f + 1) * size
        out.append((f, [(lo, hi)], [(0, max(0, lo - purge)), (min(n, hi + embargo), n)]))
    return out


def purged_kfold(df: DataFrame, k: int = 5, purge: int = PURGE, embargo: int = EMBARGO, label_end: str | None = None, min_train: float = 0.0) -> DataFrame:
    n = df.count()
    folds = fold_ranges(n, k, purge, embargo)
    if any(sum(hi - lo for lo, hi in tr if hi > lo) < max(1, min_train * n) for _, _, tr in folds):
        raise ValueError("a fold has too few training rows")
    return _roles(df, folds, label_end)


def _without(n: int, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for lo, hi in sorted(cut):
        if lo > at:
            out.append((at, lo))
        at = max(at, hi)
    return [*out, (at, n)] if at < n else out


def cpcv(df: DataFrame, groups: int = 6, tests: int = 2, purge_pct: float = 0.01, embargo_pct: float = 0.01, most: int = 20, label_end: str | None = None) -> DataFrame:
    """All combinations of test groups (every so many of them if there are more than `most`)."""
    n = df.count()
    size = n // groups
    span = [(g * size, n if g == groups - 1 else (g + 1) * size) for g in range(groups)]
    paths = list(combinations(range(groups), tests))
    if len(paths) > most:
        paths = [paths[int(i * len(paths) / most)] for i in range(most)]
    purge, embargo = int(n * purge_pct), int(n * embargo_pct)
    folds = []
    for f, path in enumerate(paths):
        test = [span[g] for g in path]
        folds.append((f, test, _without(n, [(max(0, lo - purge), min(n, hi + embargo)) for lo, hi in test])))
    return _roles(df, folds, label_end)


def walk_forward(df: DataFrame, windows: int = 5, first: float = 0.4, gap: int = PURGE, embargo: int = 0, expanding: bool = True, label_end: str | None = None) -> DataFrame:
    n = df.count()
    start = int(n * first)
    size = (n - start) // windows
    folds = []
    for f in range(windows):
        lo, hi = start + f * size, n if f == windows - 1 else start + (f + 1) * size
        begin = 0 if expanding else max(0, lo - start)
        earlier = [(start + g * size + size, min(n, start + g * size + size + embargo)) for g in range(f)] if embargo else []
        train = [(max(a, begin), min(b, lo - gap)) for a, b in _without(n, earlier)]
        folds.append((f, [(lo, hi)], train))
    return _roles(df, folds, label_end)


def fold_info(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def coverage(folds: DataFrame, n: int) -> DataFrame:
    """How many rows are tested how often."""
    times = folds.where("role = 'test'").groupBy("row_id").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("times").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / n)


def sequences(df: DataFrame, columns: list[str], length: int, label: str | None = None, stride: int = 1, max_gap: float | None = 2.0) -> DataFrame:
    """The last `length` rows up to each row as one array of arrays; none across symbols or gaps of more than max_gap times the median step."""
    r = Rolling.of_blocks()
    base = indexed(df)
    step = F.unix_seconds(F.col(TIME).cast("timestamp")) - F.unix_seconds(F.lag(TIME).over(r.order).cast("timestamp"))
    b = blocked(base, length).withColumn("_step", step)
    if max_gap is not None:
        b = with_quantiles(b, [KEY], "_step", [0.5], "_median", only=F.col("_core"), stored=True)
        jump = F.coalesce((F.col("_step") > F.col("_median")[0] * max_gap).cast("int"), F.lit(0))
    else:
        jump = F.lit(0)
    frame = r.order.rowsBetween(-(length - 1), 0)
    inner = r.order.rowsBetween(-(length - 2), 0) if length > 1 else r.order.rowsBetween(0, 0)
    b = b.withColumn("_jump", jump)
    broken = F.sum("_jump").over(inner) if length > 1 else F.lit(0)
    out = b.withColumns({"sequence": F.collect_list(F.array(*[F.col(c).cast("float") for c in columns])).over(frame), "_broken": broken})
    out = out.where(F.col("_core") & (F.size("sequence") == length) & (F.col("_broken") == 0) & ((F.col("_idx") - (length - 1)) % stride == 0))
    return out.select(KEY, TIME, "sequence", *([label] if label else []))


def multi_resolution(df: DataFrame, groups: dict[str, list[str]], length: int, label: str | None = None) -> DataFrame:
    """sequence as (timeframe, time, feature), each timeframe's features padded with 0 to the most."""
    most = max(map(len, groups.values()))
    seq = None
    for name, cols in groups.items():
        padded = df.withColumns({f"_pad{i}": F.lit(0.0) for i in range(most - len(cols))})
        one = sequences(padded, [*cols, *[f"_pad{i}" for i in range(most - len(cols))]], length, label).withColumnRenamed("sequence", f"_s_{name}")
        seq = one if seq is None else seq.join(one.drop(*([label] if label else [])), [KEY, TIME])
    return seq.select(KEY, TIME, F.array(*[F.col(f"_s_{n}") for n in groups]).alias("tensor"), *([label] if label else []))


def stacking_features(df: DataFrame, models: list[str], classes: int = 3) -> DataFrame:
    """Agreement, confidence and entropy over the models' probability columns {model}_p0, ... of a row."""
    probs = {m: F.array(*[F.col(f"{m}_p{k}") for k in range(classes)]) for m in models}
    preds = F.array(*[F.array_position(p, F.array_max(p)).cast("int") - 1 for p in probs.values()])
    conf = F.array(*[F.array_max(p) for p in probs.values()])
    ent = F.array(*[-F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-10)) for p in probs.values()])
    n = len(models)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    counts = F.array_max(F.array(*[F.aggregate(preds, F.lit(0), _count_of(c)) for c in range(classes)]))
    mean = total(F.transform(preds, lambda p: p.cast("double"))) / n
    var = F.aggregate(preds, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, p: F.struct((a["s"] + F.pow(p - a["m"], 2)).alias("s"), a["m"].alias("m")), lambda a: a["s"] / max(1, n - 1))
    avg_p = [total(F.array(*[F.col(f"{m}_p{k}") for m in models])) / n for k in range(classes)]
    whole = F.lit(0.0)
    for p in avg_p:
        whole = whole - p * F.ln(p + 1e-10)
    return df.withColumns({
        "models_agree": (counts == n).cast("int"), "agreement_count": counts.cast("int"), "avg_confidence": total(conf) / n, "min_confidence": F.array_min(conf), "max_confidence": F.array_max(conf),
        "prediction_entropy": whole, "avg_entropy": total(ent) / n, "prediction_std": F.sqrt(var),
    })


def _count_of(c: int):
    return lambda a, p: a + (p == c).cast("int")


def pbo(perf: DataFrame, partitions: int, most: int = 100) -> DataFrame:
    """Probability of backtest overfitting of (strategy, path, perf): one row a combination of half the partitions.

    The strategy that is best on the chosen half is ranked (average ties) on the other
    half; logit of its relative rank.  Combinations are at most `most`, evenly taken.
    """
    paths = perf.select("path").distinct().withColumn("part", F.ntile(partitions).over(W.orderBy("path")) - 1)  # a row a path
    combos = list(combinations(range(partitions), partitions // 2))
    if len(combos) > most:
        combos = [combos[int(i * len(combos) / most)] for i in range(most)]
    rows = [(i, p, int(p in c)) for i, c in enumerate(combos) for p in range(partitions)]
    table = perf.sparkSession.createDataFrame(rows, "combo int, part int, inside int")
    m = perf.join(F.broadcast(paths), "path").join(F.broadcast(table), "part").groupBy("combo", "strategy").agg(F.avg(F.when(F.col("inside") == 1, F.col("perf"))).alias("is_perf"), F.avg(F.when(F.col("inside") == 0, F.col("perf"))).alias("oos_perf"))
    w = W.partitionBy("combo")
    best = F.row_number().over(w.orderBy(F.desc("is_perf"), "strategy"))
    rank = F.rank().over(w.orderBy("oos_perf")) + (F.count(F.lit(1)).over(W.partitionBy("combo", "oos_perf")) - 1) / 2
    n = F.count(F.lit(1)).over(w)
    out = m.withColumns({"_b": best, "_q": rank / (n + 1)}).where("_b = 1")
    return out.select("combo", "strategy", "is_perf", "oos_perf", F.col("_q").alias("relative_rank"), F.ln(F.col("_q") / (1 - F.col("_q"))).alias("logit"))
