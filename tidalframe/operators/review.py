"""Checks of tables before training: moves, labels, splits, folds, scaling and predictions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import timeframe_minutes
from ..series import KEY, TIME, Rolling, with_features
from . import clean, splits, stats
from .labels import INVALID

LABELS = (-1, 0, 1)
#: Barrier multipliers of the trading presets.
PRESETS = (("scalping", 0.7), ("day_trading", 1.0), ("swing", 1.3))


def roll_moves(df: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Bars whose close moved by more than the threshold: key, time, change. Nothing is altered."""
    r = Rolling.of_blocks()
    change = r.c / F.nullif(r.lag(r.c), F.lit(0.0)) - 1
    return with_features(df, {"change": change}, 1).where(F.abs("change") > threshold).select(KEY, TIME, "change")


def outlier_counts(df: DataFrame) -> DataFrame:
    """rows, and how many each method finds, of each key."""
    found = clean.zscore_outliers(df).withColumnRenamed("outlier", "_z")
    found = clean.iqr_outliers(found)
    return found.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if("_z").alias("zscore"), F.count_if("outlier").alias("iqr"), F.count_if(F.col("_z") | F.col("outlier")).alias("either"))


def invalid_labels(df: DataFrame, label: str, valid: tuple[int, ...] = LABELS) -> DataFrame:
    """label, n of the values that training may not see, null among them."""
    return df.where(~F.coalesce(F.col(label).isin(*valid), F.lit(False))).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_of(label: Column) -> Column:
    """-1, 0, 1 -> 0, 1, 2; anything else fails."""
    return F.when(label.isin(*LABELS), label + 1).otherwise(F.raise_error(F.concat(F.lit("no label: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def label_of(cls: Column) -> Column:
    return F.when(cls.isin(*[v + 1 for v in LABELS]), cls - 1).otherwise(F.raise_error(F.concat(F.lit("no class: "), F.coalesce(cls.cast("string"), F.lit("null")))).cast("int"))


def preset_barriers(df: DataFrame, preset: str) -> DataFrame:
    """df (k_up, k_down) times the preset's multiplier, to two digits."""
    m = dict(PRESETS)[preset]
    return df.withColumns({c: F.bround(F.col(c) * m, 2) for c in ("k_up", "k_down")})


def resampling_info(source: str, target: str) -> dict[str, object]:
    """Bars of the source in one of the target; a target that is finer, or no multiple, is refused."""
    a, b = timeframe_minutes(source), timeframe_minutes(target)
    if b < a or b % a:
        raise ValueError(f"{target} cannot be made of {source}")
    return {"source": source, "target": target, "source_minutes": a, "target_minutes": b, "bars_per_target": b // a, "scale_factor": b / a}


def meta_metrics(df: DataFrame, horizon: int) -> DataFrame:
    """Of each key: valid and right signals, accuracy, and the margins of right and wrong ones."""
    lab, m = F.col(f"meta_label_h{horizon}"), F.abs(f"margin_h{horizon}")
    valid, right, wrong = F.count_if(lab != INVALID), F.avg(F.when(lab == 1, m)), F.avg(F.when(lab == 0, m))
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total"), valid.alias("valid"), F.count_if(lab == 1).alias("right"), F.count_if(lab == 0).alias("wrong"),
        (F.count_if(lab == 1) / F.nullif(valid, F.lit(0))).alias("accuracy"), right.alias("right_margin"), wrong.alias("wrong_margin"), (right / F.nullif(wrong, F.lit(0.0))).alias("margin_ratio"),
    )


def overlaps(split: DataFrame, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """a, b, n: how many rows (row_id) two splits have in common, in one pass by row."""
    by = split.groupBy("row_id").agg(F.collect_set("split").alias("in"))
    pairs = list(combinations(names, 2))
    counts = by.agg(*[F.count_if(F.array_contains("in", a) & F.array_contains("in", b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def share_check(split: DataFrame, least: float = 20.0) -> DataFrame:
    return splits.symbol_shares(split).withColumn("ok", F.col("pct") >= least)


def sequence_coverage(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Of each key: rows, sequences that end in one of them, and their share."""
    n = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    s = sequences.groupBy(KEY).agg(F.count(F.lit(1)).alias("sequences"))
    return n.join(s, KEY, "left").select(KEY, "rows", F.coalesce("sequences", F.lit(0).cast("long")).alias("sequences"), (F.coalesce("sequences", F.lit(0)) / F.col("rows")).alias("share"))


def scale_fold(df: DataFrame, folds: DataFrame, columns: list[str], clip: float = stats.CLIP) -> DataFrame:
    """row_id, fold, role and the columns of df (row_id) less the mean of their fold's training rows over their deviation, clipped."""
    x = folds.join(df.select("row_id", *columns), "row_id")
    train = lambda c: F.when(F.col("role") == "train", F.col(c))
    fit = x.groupBy("fold").agg(*[e for c in columns for e in (F.avg(train(c)).alias(f"_m_{c}"), F.stddev_pop(train(c)).alias(f"_s_{c}"))])
    out = x.join(F.broadcast(fit), "fold")  # a row a fold
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.select("row_id", "fold", "role", *[F.greatest(F.least(z(c), F.lit(clip)), F.lit(-clip)).alias(c) for c in columns])


def scale_splits(split: DataFrame, columns: list[str], kind: str = "robust", logs: tuple[str, ...] = ()) -> DataFrame:
    """All splits scaled by what the training rows alone give."""
    return stats.transform(split, stats.fit_scaler(split.where("split = 'train'"), columns, kind, logs))


def scaling_report(scaled: DataFrame, columns: list[str], threshold: float = 5.0) -> DataFrame:
    """split, name, n, missing, mean, std, shift (training deviations between the means), drifted."""
    x = stats.unpivot(scaled, columns, ["split"])
    s = x.groupBy("split", "name").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("missing"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    base = s.where("split = 'train'").select("name", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    shift = F.abs(F.col("mean") - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    return s.join(F.broadcast(base), "name").withColumn("shift", shift).withColumn("drifted", F.coalesce(F.col("shift") > threshold, F.lit(False))).drop("_m", "_s")  # a row a column


def valid_rows(df: DataFrame, models: list[str]) -> DataFrame:
    """Rows for which every model has a prediction ({model}_p0 neither null nor NaN)."""
    ok = F.lit(True)
    for m in models:
        ok = ok & F.col(f"{m}_p0").isNotNull() & ~F.isnan(f"{m}_p0")
    return df.where(ok)


def merged_predictions(frames: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """truth (row_id, ...) with the columns of each model's out-of-fold frame (row_id, p0, ...) as {model}_p0, ...; rows that a model lacks go."""
    out = truth
    for m, f in frames.items():
        out = out.join(f.select("row_id", *[F.col(c).alias(f"{m}_{c}") for c in f.columns if c != "row_id"]), "row_id", "left")
    return valid_rows(out, list(frames))


def prediction_coverage(df: DataFrame, models: list[str]) -> DataFrame:
    """model, rows, missing and coverage of each model."""
    x = stats.unpivot(df, [f"{m}_p0" for m in models])
    gone = F.count_if(F.col("x").isNull() | F.isnan("x"))
    s = x.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), gone.alias("missing"))
    return s.select(F.substring_index("name", "_p0", 1).alias("model"), "rows", "missing", (1 - F.col("missing") / F.col("rows")).alias("coverage"))


def prediction_correlations(df: DataFrame, models: list[str], column: str = "p0") -> DataFrame:
    """a, b, corr of two models' predictions; diverse: under 0.7."""
    out = stats.correlations(df.select(*[F.col(f"{m}_{column}").alias(m) for m in models]), models)
    return out.withColumn("diverse", F.col("corr") < 0.7)


def label_sanity(df: DataFrame, label: str, low: float = 20.0, high: float = 60.0) -> DataFrame:
    """label, n, pct of the valid labels, and what is wrong with the share."""
    from pyspark.sql import Window as W

    n = df.where(F.col(label) != INVALID).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())  # a row a label
    return n.withColumn("pct", pct).withColumn("warning", F.when(F.col("pct") < low, "rare").when(F.col("pct") > high, "dominant").otherwise("none"))


def model_ready(split: DataFrame, columns: list[str], label: str, reach: float = stats.CLIP, least: float = 5.0) -> DataFrame:
    """Of each split: rows, missing and out-of-range values, constant columns, labels that are invalid, share of the rarest label, ready."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    far = lambda c: F.coalesce(F.abs(c) > reach, F.lit(False))
    total = lambda f: sum((F.count_if(f(c)) for c in columns[1:]), F.count_if(f(columns[0])))
    flat = sum(((F.min(c) == F.max(c)).cast("int") for c in columns[1:]), (F.min(columns[0]) == F.max(columns[0])).cast("int"))
    lab, ok = F.col(label), F.col(label).isin(*LABELS)
    share = F.least(*[F.count_if(lab == v) for v in LABELS]) * 100.0 / F.nullif(F.count_if(ok), F.lit(0))
    out = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), total(bad).alias("missing"), total(far).alias("out_of_range"), flat.cast("int").alias("constant"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid_labels"), share.alias("rarest_pct"))
    return out.withColumn("ready", (F.col("missing") == 0) & (F.col("out_of_range") == 0) & (F.col("constant") == 0) & (F.col("invalid_labels") == 0) & (F.coalesce("rarest_pct", F.lit(0.0)) >= least))


def selected_features(df: DataFrame, columns: list[str], correlation: float = 0.85, variance: float = 1e-4) -> DataFrame:
    """name, fate: kept, low_variance, or correlated with a column that is kept."""
    low = {r["name"] for r in stats.low_variance(df, columns, variance).where("drop").collect()}  # a row a column
    rest = [c for c in columns if c not in low]
    groups = stats.correlated_groups(df, rest, correlation) if rest else {}
    fate = {c: "low_variance" for c in low} | {c: "kept" for c in groups} | {c: "correlated" for g in groups.values() for c in g}
    return df.sparkSession.createDataFrame([(c, fate[c]) for c in columns], "name string, fate string")


def drift(expected: DataFrame, actual: DataFrame, columns: list[str], method: str = "psi", threshold: float = 0.2) -> DataFrame:
    """name, value, drifted of each column: PSI between quantile bins, or the Kolmogorov-Smirnov statistic."""
    if method == "psi":
        out = stats.psi_quantile(expected, actual, columns).withColumnRenamed("psi", "value")
    elif method == "ks":
        out = stats.ks(expected, actual, columns).select("name", F.col("statistic").alias("value"))
    else:
        raise ValueError(f"no drift method {method!r}")
    return out.withColumn("drifted", F.col("value") > threshold)


def drift_summary(found: DataFrame) -> DataFrame:
    """One row: columns, drifted ones, their share, and the largest value."""
    n = F.count(F.lit(1))
    return found.agg(n.alias("n_columns"), F.count_if("drifted").alias("n_drifted"), (F.count_if("drifted") / F.nullif(n, F.lit(0))).alias("share"), F.max("value").alias("worst"))


def split_drift(split: DataFrame, columns: list[str], threshold: float = 0.2) -> DataFrame:
    """split, name, value, drifted: PSI from the training rows to those of each other split."""
    train = split.where("split = 'train'")
    parts = [drift(train, split.where(F.col("split") == s), columns, "psi", threshold).withColumn("split", F.lit(s)) for s in ("val", "test")]
    return parts[0].unionByName(parts[1])


def lookahead_audit(df: DataFrame, make, columns: list[str], start: str, tolerance: float = 1e-10) -> DataFrame:
    """name, n, changed of each column that make(df) adds: how many values before `start` change when prices and volume from there on are gone."""
    future = F.col(TIME) >= F.lit(start).cast("timestamp_ntz")
    gone = df.withColumns({c: F.when(~future, F.col(c)) for c in (*clean.PRICES, "volume") if c in df.columns})
    whole = stats.unpivot(make(df).where(~future), columns, [KEY, TIME])
    other = stats.unpivot(make(gone).where(~future), columns, [KEY, TIME]).withColumnRenamed("x", "_y")
    same = F.col("x").eqNullSafe(F.col("_y")) | F.coalesce(F.abs(F.col("x") - F.col("_y")) <= tolerance, F.lit(False))
    return whole.join(other, [KEY, TIME, "name"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("changed"))


def alignment_check(base: DataFrame, aligned: DataFrame, columns: list[str]) -> DataFrame:
    """key, name, in_span, first_null, leading_nulls: whether a coarser frame's columns begin without a value, and lie within the base's time."""
    span = base.groupBy(KEY).agg(F.min(TIME).alias("_lo"), F.max(TIME).alias("_hi"))
    x = stats.unpivot(aligned, columns, [KEY, TIME])
    some = F.min(F.when(F.col("x").isNotNull(), F.col(TIME)))
    found = x.groupBy(KEY, "name").agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"), some.alias("_v"))
    early = x.join(found, [KEY, "name"]).groupBy(KEY, "name").agg(F.count_if(F.col("_v").isNull() | (F.col(TIME) < F.col("_v"))).alias("leading_nulls"))
    out = found.join(early, [KEY, "name"]).join(span, KEY)
    return out.select(KEY, "name", ((F.col("_a") >= F.col("_lo")) & (F.col("_b") <= F.col("_hi"))).alias("in_span"), (F.col("leading_nulls") > 0).alias("first_null"), "leading_nulls")


def trend_by_strength(df: DataFrame, period: int = 14, long: int = 50, threshold: float = 25.0) -> DataFrame:
    """df with trend: uptrend or downtrend where the ADX is over the threshold and the close off its mean, else sideways; null in the warm-up."""
    from ..functions import recursive

    cols = list(df.columns)
    make = lambda p: {"_adx": recursive.adx(*(p[x].to_numpy(dtype=float) for x in ("high", "low", "close")), period)[0]}
    got = recursive.scanned(df, ["high", "low", "close"], make, ["_adx"], recursive.WARM * period, cols)
    r = Rolling.of_blocks()
    out = with_features(got, {"_mean": r.mean(r.c, long)}, long, keep=[*cols, "_adx"])
    adx = F.when(~F.isnan("_adx"), F.col("_adx"))
    strong = adx > threshold
    trend = F.when(adx.isNull() | F.col("_mean").isNull(), None).when(strong & (F.col("close") > F.col("_mean")), "uptrend").when(strong & (F.col("close") < F.col("_mean")), "downtrend").otherwise("sideways")
    return out.withColumn("trend", trend).drop("_adx", "_mean")
