"""Model-based operators on pyspark.ml: importance by impurity and by permutation, out-of-fold predictions, isotonic calibration."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..series import TIME
from ..tables import kept
from .splits import positions
from .stats import fit_scaler, transform


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df)


def _forest(df: DataFrame, columns: list[str], label: str, trees: int, depth: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(df, columns))


def _by_impurity(df: DataFrame, model, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(model.featureImportances[i])) for i, c in enumerate(columns)], "name string, importance double")


def importance(df: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """name, importance: mean decrease of impurity over a random forest."""
    return _by_impurity(df, _forest(df, columns, label, trees, depth, seed), columns)


def permutations(n: int, columns: list[str], repeats: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(column, repeat, a, b): the value of row j goes to row (a * j + b) mod n, a bijection as a and n have no common factor."""
    most = max(min(n - 1, (1 << 62) // max(n, 1)), 1)  # products stay whole numbers of 64 bits
    out = []
    for i, c in enumerate(columns):
        for r in range(repeats):
            rng = random.Random(f"{seed}:{c}:{r}")
            a = rng.randint(1, most)
            while math.gcd(a, n) != 1:
                a = a % most + 1
            out.append((i, r, a, rng.randrange(max(n, 1))))
    return out


def permuted_accuracy(df: DataFrame, model, columns: list[str], label: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """name, mean, std: what a model's accuracy loses, over `repeats` seeded permutations of each column.

    Every row sends each column's value to the rows that the permutations give it to; one join on row numbers and one
    pass of the model judge all of them.  Rows with a null in a column or label take no part.
    """
    from pyspark.ml.functions import array_to_vector

    rows = kept(positions(df.where(" and ".join(f"`{c}` is not null" for c in [*columns, label])).select(TIME, *columns, label)).select("row_id", *columns, label), "rows")
    n = rows.count()
    x = rows.select("row_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"))
    sent = [F.struct(F.lit(i).alias("c"), F.lit(r).alias("r"), ((F.col("row_id") * a + b) % max(n, 1)).alias("to"), F.get("x", F.lit(i)).alias("v")) for i, r, a, b in permutations(n, columns, repeats, seed)]
    asked = x.select(F.explode(F.array(*sent)).alias("s")).select("s.*")
    # c = -1 is the row as it is.
    whole = x.select(F.lit(-1).alias("c"), F.lit(0).alias("r"), "x", "y")
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("c"), F.col("v")).otherwise(v))
    tried = asked.join(x, F.col("to") == F.col("row_id")).select("c", "r", swapped.alias("x"), "y").unionByName(whole)
    judged = model.transform(tried.withColumn("_x", array_to_vector("x")))
    right = judged.groupBy("c", "r").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("right"))
    right = kept(right, "accuracy")  # a row a column and repeat
    base = right.where("c = -1").select(F.col("right").alias("base"))
    lost = right.where("c >= 0").crossJoin(F.broadcast(base)).withColumn("lost", F.col("base") - F.col("right"))
    name = F.get(F.array(*map(F.lit, columns)), F.col("c"))
    return lost.groupBy(name.alias("name")).agg(F.avg("lost").alias("mean"), F.stddev_pop("lost").alias("std"))


def permutation_importance(df: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 5, seed: int = 42, repeats: int = 10) -> DataFrame:
    """name, importance: what a random forest's accuracy loses when a column is permuted."""
    model = _forest(df, columns, label, trees, depth, seed)
    return permuted_accuracy(df, model, columns, label, repeats, seed).select("name", F.col("mean").alias("importance"))


def hybrid_importance(df: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 5, seed: int = 42, repeats: int = 10) -> DataFrame:
    """name, importance: the mean of the ascending ranks of both kinds; ties share their mean rank."""
    model = _forest(df, columns, label, trees, depth, seed)
    both = _by_impurity(df, model, columns).join(permuted_accuracy(df, model, columns, label, repeats, seed), "name")

    def rank(c: str):
        same, upto = W.partitionBy(c), W.partitionBy().orderBy(c)  # a row a column
        return F.rank().over(upto) + (F.count(F.lit(1)).over(same) - 1) / 2

    return both.select("name", ((rank("importance") + rank("mean")) / 2).alias("importance"))


METHODS = {"mdi": importance, "mda": permutation_importance, "hybrid": hybrid_importance}


def chosen_often(df: DataFrame, folds: DataFrame, columns: list[str], label: str, top: int, least: float = 0.6, method: str = "mdi", **options) -> DataFrame:
    """name, folds, share, keep: how often a column is among the top ones of a fold's training rows; ties go by name."""
    p, folds = kept(positions(df), "rows"), kept(folds, "folds")
    ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # a row a fold
    picked = None
    for f in ids:
        train = p.join(folds.where((F.col("fold") == f) & (F.col("role") == "train")).select("row_id"), "row_id", "left_semi").drop("row_id")
        one = METHODS[method](train, columns, label, **options).orderBy(F.desc("importance"), "name").limit(top).select("name")
        picked = one if picked is None else picked.unionByName(one)
    share = F.col("folds") / len(ids)
    return picked.groupBy("name").agg(F.count(F.lit(1)).alias("folds")).withColumns({"share": share, "keep": share >= least})


def out_of_fold(df: DataFrame, folds: DataFrame, columns: list[str], label: str, scaler: str = "robust", classes: int = 3) -> DataFrame:
    """row_id, fold, y, p0.. of a logistic regression fitted and scaled on each fold's training rows; rows never tested are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    p, folds = kept(positions(df), "rows"), kept(folds, "folds")
    out = None
    for f in (r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()):  # a row a fold
        rows = kept(p.join(folds.where(F.col("fold") == f).select("row_id", "role"), "row_id"), "fold")
        train = rows.where("role = 'train'")
        x = _assembled(transform(rows, fit_scaler(train, columns, scaler)), columns)
        model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", maxIter=20, regParam=0.01).fit(x.where("role = 'train'"))
        got = model.transform(x.where("role = 'test'")).withColumn("_a", vector_to_array("_p"))
        one = got.select("row_id", F.lit(f).alias("fold"), F.col(label).cast("int").alias("y"), *[F.coalesce(F.get("_a", F.lit(k)), F.lit(0.0)).alias(f"p{k}") for k in range(classes)])
        out = one if out is None else out.unionByName(one)
    return out


def calibrated(df: DataFrame, truth: str, probs: list[str]) -> DataFrame:
    """df with each class's probability made isotonic in what was true, clipped and renormalised."""
    from pyspark.ml.regression import IsotonicRegression

    out = df
    for k, p in enumerate(probs):
        y = df.select(F.col(p).alias("_f"), (F.col(truth) == k).cast("double").alias("_y"))
        model = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="_q").fit(y)
        out = model.transform(out.withColumn("_f", F.col(p))).withColumn(f"_c{k}", F.greatest(F.least("_q", F.lit(1 - 1e-6)), F.lit(1e-6))).drop("_f", "_q")
    total = sum((F.col(f"_c{k}") for k in range(1, len(probs))), F.col("_c0"))
    return out.withColumns({p: F.col(f"_c{k}") / total for k, p in enumerate(probs)}).drop(*[f"_c{k}" for k in range(len(probs))])
