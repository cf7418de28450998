"""Reading, writing and auditing bar tables; paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import json
import posixpath
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..series import KEY, TIME

BAR = "datetime timestamp_ntz, open double, high double, low double, close double, volume long"


class PathNotAllowed(ValueError):
    pass


def allowed(path: str, roots: list[str]) -> str:
    """path if it lies under one of the roots and climbs nowhere."""
    parts = urlsplit(path)
    if ".." in parts.path.split("/") or "~" in path:
        raise PathNotAllowed(f"{path!r} climbs out of its folder")
    clean_path = f"{parts.scheme}://{parts.netloc}" * bool(parts.scheme) + posixpath.normpath(parts.path)
    if not any(clean_path == r.rstrip("/") or clean_path.startswith(r.rstrip("/") + "/") for r in roots):
        raise PathNotAllowed(f"{path!r} is under none of {', '.join(roots)}")
    return path


def load(spark: SparkSession, path: str, roots: list[str], kind: str | None = None) -> DataFrame:
    """A CSV file with a header (all text) or Parquet; without rows an error."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    allowed(path, roots)
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {kind!r}; there are csv and parquet")
    if df.isEmpty():
        raise ValueError(f"{path!r} has no rows")
    return df


def symbol_of(path: Column | str) -> Column:
    """The part of a file's name before the first underscore, in upper case."""
    path = F.lit(path) if isinstance(path, str) else path
    return F.upper(F.split(F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)?$", 1), "_")[0])


def ingest(spark: SparkSession, path: str, roots: list[str], zone: str = "UTC", symbol: str | None = None) -> DataFrame:
    """load, standardise, coerce, to UTC and repair; the symbol is a column's, the argument or the file's."""
    raw = load(spark, path, roots)
    named = raw.withColumn("_file", F.col("_metadata.file_path"))
    df = clean.repair(clean.to_utc(clean.coerce(clean.standardise(named)), zone))
    known = F.col(KEY) if KEY in df.columns else F.lit(symbol)
    return df.withColumn(KEY, F.coalesce(known, symbol_of(F.col("_file")))).select(KEY, TIME, *clean.PRICES, "volume")


def ingest_many(spark: SparkSession, paths: list[str], roots: list[str], target: str, **options) -> dict[str, str]:
    """Every file appended to target by symbol; what fails is collected and raised at the end."""
    errors = {}
    for p in paths:
        try:
            ingest(spark, p, roots, **options).write.mode("append").partitionBy(KEY).parquet(target)
        except (ValueError, FileNotFoundError) as e:
            errors[p] = str(e)
    if errors:
        raise ValueError("; ".join(f"{p}: {e}" for p, e in errors.items()))
    return errors


def holdout(df: DataFrame, cutoff: str) -> DataFrame:
    """df with part: train before the cutoff, holdout from it on; write it partitioned by part to prune on reading."""
    return df.withColumn("part", F.when(F.col(TIME) < F.lit(cutoff).cast("timestamp_ntz"), "train").otherwise("holdout"))


def save(df: DataFrame, path: str, metadata: dict | None = None, by: list[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*by).parquet(path)
    if metadata is not None:
        df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows, and a sum of row hashes that does not depend on their order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, checksum of each table."""
    out = None
    for name, df in tables.items():
        one = checksum(df).select(F.lit(name).alias("name"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, status: added, removed, modified or unchanged between two manifests."""
    a, b = old.select("name", F.col("checksum").alias("_a")), new.select("name", F.col("checksum").alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified").otherwise("unchanged")
    return a.join(b, "name", "full").select("name", status.alias("status"))


def verify(known: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """name, same: whether a table still has the checksum that a manifest knows."""
    now = manifest(tables).select("name", F.col("checksum").alias("_now"))
    return known.join(now, "name").select("name", (F.col("checksum") == F.col("_now")).alias("same"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, columns, their names, the span of time and a hash of the schema."""
    names = ",".join(sorted(df.columns))
    kinds = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time")).select("rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(names).alias("names"), "first_time", "last_time", F.sha2(F.lit(kinds), 256).alias("schema_hash"))


def forecasting(df: DataFrame, target: str, weight: str | None = None, features: list[str] = ()) -> DataFrame:
    """unique_id, ds, y, sample_weight and features."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.select(F.col(KEY).alias("unique_id"), F.col(TIME).alias("ds"), F.col(target).alias("y"), w.alias("sample_weight"), *features)


def features_of(columns: list[str], include: list[str] = (), exclude: list[str] = (), metadata: tuple[str, ...] = (KEY, TIME, *clean.PRICES, "volume"), labels: tuple[str, ...] = ("label_", "bars_to_hit_", "mae_", "mfe_", "quality_", "sample_weight_", "touch_type_", "fwd_return_")) -> list[str]:
    """The columns that are neither metadata nor labels, by prefixes to include and exclude."""
    out = [c for c in columns if c not in metadata and not c.startswith(tuple(labels))]
    if include:
        out = [c for c in out if c.startswith(tuple(include))]
    return [c for c in out if not (exclude and c.startswith(tuple(exclude)))]


def save_splits(split: DataFrame, root: str, columns: list[str], label: str, others: list[str] = ()) -> DataFrame:
    """The splits' metadata, features and label under root, one folder a split; returns rows and checksum of each."""
    keep = [c for c in (KEY, TIME, "row_id", "split") if c in split.columns]
    split.select(*keep, *columns, label, *others).write.mode("overwrite").partitionBy("split").parquet(root)
    back = split.sparkSession.read.parquet(root)
    h = F.xxhash64(*[F.col(c) for c in sorted(back.columns) if c != "split"]).cast("decimal(38,0)")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("checksum"))


def read_splits(spark: SparkSession, root: str, label: str, part: str | None = None, invalid: int | None = -99) -> DataFrame:
    """What save_splits() wrote, of one split if part names it (only its folder is read), without invalid labels."""
    df = spark.read.parquet(root)
    if part is not None:
        df = df.where(F.col("split") == part)
    return df if invalid is None else df.where(F.col(label) != invalid)


def save_stacking(df: DataFrame, root: str, horizon: int, models: list[str]) -> None:
    """A stacking table and its metadata for a horizon."""
    save(df, f"{root}/stacking_h{horizon}", {"horizon": horizon, "models": models, "columns": df.columns})
