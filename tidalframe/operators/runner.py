"""Cross-validation with columns picked in each fold, by training rows alone.

The information that a column has about the label is that of its ten bins between training quantiles: one exact quantile
step over all folds and columns, one contingency count, and sums over its few rows.  Rows multiply by folds and columns before these
aggregates combine them.

Defined cases: rows with a null value or label do not count for that column; ties go by name; a fold whose training rows have
one class is scored like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..quantiles import quantiles, renamed, same
from ..tables import kept
from .models import out_of_fold
from .splits import positions
from .stats import classification

BINS = 10


def fold_information(df: DataFrame, folds: DataFrame, columns: list[str], label: str, bins: int = BINS) -> DataFrame:
    """fold, name, information (nats) of each column about the label on the fold's training rows (folds: row_id, fold, role)."""
    train = positions(df).join(folds.where("role = 'train'").select("row_id", "fold"), "row_id")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = train.where(F.col(label).isNotNull()).select("fold", F.col(label).alias("y"), each.alias("s")).select("fold", "y", "s.*").where("x is not null")
    long = kept(long, "fold-values")
    keys = ["fold", "name"]
    edges = quantiles(long, keys, "x", [i / bins for i in range(1, bins)], "edges")
    placed = long.join(renamed(edges, keys), same(keys)).select(*keys, "y", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin"))
    n = placed.groupBy(*keys, "bin", "y").agg(F.count(F.lit(1)).alias("n"))  # at most bins * classes rows a fold and column
    over = lambda *more: F.sum("n").over(W.partitionBy(*keys, *more))
    n = n.withColumns({"all": over(), "of_bin": over("bin"), "of_y": over("y")})
    part = F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("of_bin") * F.col("of_y")))
    return n.groupBy(*keys).agg(F.sum(part).alias("information"))


def picked(information: DataFrame, k: int) -> DataFrame:
    """fold, name, rank of the k columns that tell most in each fold."""
    rank = F.row_number().over(W.partitionBy("fold").orderBy(F.desc("information"), "name"))  # a row a column
    return information.withColumn("rank", rank).where(F.col("rank") <= k).select("fold", "name", "rank", "information")


def cross_validated(df: DataFrame, folds: DataFrame, columns: list[str], label: str, k: int, scaler: str = "robust", classes: int = 3) -> DataFrame:
    """fold, columns, rows, accuracy, f1 (macro): a logistic regression on the k columns picked in the fold, judged on its test rows."""
    folds = kept(folds, "folds")
    names: dict = {}
    for r in picked(fold_information(df, folds, columns, label), k).orderBy("fold", "rank").collect():  # k rows a fold
        names.setdefault(r["fold"], []).append(r["name"])
    out = None
    for f, chosen in names.items():
        got = out_of_fold(df, folds.where(F.col("fold") == f), chosen, label, scaler, classes)
        probs = F.array(*[F.col(f"p{c}") for c in range(classes)])
        got = kept(got.withColumn("pred", (F.array_position(probs, F.array_max(probs)) - 1).cast("int")), "fold-predictions")
        f1 = classification(got).where("name = 'macro'").select("f1")
        one = got.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
        one = one.join(f1, F.lit(True), "left").select(F.lit(f).alias("fold"), F.array(*map(F.lit, chosen)).alias("columns"), "rows", "accuracy", "f1")  # a row each
        out = one if out is None else out.unionByName(one)
    return out


def tuning_score(scores: DataFrame, column: str = "f1", penalty: float = 0.1) -> DataFrame:
    """mean, std, stability (std / mean) and score: the mean less a tenth of the standard deviation over folds."""
    x = scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return x.withColumns({"stability": F.col("std") / F.nullif("mean", F.lit(0.0)), "score": F.col("mean") - penalty * F.col("std")})
