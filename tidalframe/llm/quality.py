"""Quality classifier by positive-unlabelled learning.

The trusted positives are documents labelled 1; the unlabelled ones are documents
of the labelled part of the corpus whose labels are hidden from the fit, so that the prior is theirs.  A linear model over counts of a text's
characters, words and lines minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the logistic loss; where the second term would be negative its gradient is
turned round.  The prior is the share of label 1 among training labels, or, if
only positives are labelled, estimated from the scores of a first model.

The fit takes bounded samples of labelled rows in an order of hashed ids (MAX_POSITIVE and
MAX_UNLABELLED documents at most, parameters of fit); scoring reads every text once
and shuffles none.

Defined cases: null and empty texts are scored like any other (all counts 0); a
null id belongs to the training part; labels that are null are ignored; repeated rows get
one score, and of sampled rows of one id one is taken; a text is counted as a whole, in
some 50 bytes a character; an empty table gives an empty result; without
any positive label every score is the prior or, without labels, 0.5; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_POSITIVE = 8_192
MAX_UNLABELLED = 16_384
THRESHOLD = 0.7

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_GROUPS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), [32], [10], [9], [*range(9), *range(11, 32), 127]]
FEATURES = len(_GROUPS) + len(_MARKS) + 9


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES numbers for each whole text."""
    out = np.zeros((len(texts), FEATURES))
    groups = np.zeros((256, len(_GROUPS) + len(_MARKS)))
    for j, g in enumerate(_GROUPS):
        groups[list(g), j] = 1
    for j, c in enumerate(_MARKS):
        groups[ord(c), len(_GROUPS) + j] = 1
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ groups
        words = text.split()
        n = max(1, len(words))
        lines = text.split("\n")
        same = sum(map(eq, words, words[1:]))
        k = len(_GROUPS) + len(_MARKS)
        out[i, :k] = np.log1p(100 * counts / len(raw))
        out[i, k:] = (
            np.log1p(len(words)),
            len(text) / n / 10,
            len(set(words)) / n**0.8,
            same / n,
            np.log1p(100 * same / n),
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            sum(map(str.isupper, words)) / n,
            np.log1p(max(map(len, words), default=0)),
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the whole of both samples; no randomness."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale[scale < 1e-9] = 1.0
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        plus = -(p * sig(-zp)[:, None]).mean(0)
        minus_p = (p * sig(zp)[:, None]).mean(0)
        minus_u = (u * sig(zu)[:, None]).mean(0)
        if loss(-zu).mean() - prior * loss(-zp).mean() >= 0:
            g = prior * plus + minus_u - prior * minus_p
        else:
            g = prior * minus_p - minus_u
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """For labels that are all 1: mean score of the unlabelled over that of positives, under a model of labelled against not."""
    half = np.arange(len(positive)) % 2 == 0
    share = half.sum() / (half.sum() + len(unlabelled))
    first = fit_nnpu(positive[half], np.vstack([positive[half], unlabelled]), share)
    c = first.scores(positive[~half]).mean() if (~half).any() else 1.0
    return float(np.clip(first.scores(unlabelled).mean() / max(c, 1e-6), 0.05, 0.95))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(common.id_text(key).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    train = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    stats = train.agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    order = F.xxhash64("doc_id")
    pos = train.where("quality = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive)
    free = train.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    # Both sides have bounded numbers of ids, so the join may broadcast them; of rows of one id any one is taken.
    want = pos.select("doc_id", F.lit(1).alias("is_pos")).unionByName(free.select("doc_id", F.lit(0).alias("is_pos")))
    rows = docs.select("doc_id", "text").join(F.broadcast(want), "doc_id").groupBy("doc_id", "is_pos").agg(F.min("text").alias("text")).select("text", "is_pos")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"is_pos": b["is_pos"], "x": list(features(b["text"].tolist()))})

    found = rows.mapInPandas(count, "is_pos int, x array<double>").toPandas()
    split = [np.vstack(x) if len(x := found.loc[found["is_pos"] == k, "x"]) else np.zeros((0, FEATURES)) for k in (1, 0)]
    flat = lambda p: Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(p / (1 - p))), p)
    if not len(split[0]) or not len(split[1]):
        return flat(0.5 if not stats["n"] else float(np.clip(stats["pos"] / stats["n"], 0.01, 0.99)))
    order = [x[np.lexsort(x.T)] for x in split]  # the same sums whatever the order of tasks
    prior = stats["pos"] / stats["n"] if stats["pos"] < stats["n"] else estimated_prior(*order)
    return fit_nnpu(*order, float(np.clip(prior, 0.01, 0.99)))


def score(docs: DataFrame, model: Model) -> Column:
    """A column of scores over docs' text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.scores(features(b.tolist())))

    return scored(docs["text"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; columns of docs of these names are replaced."""
    model = fit(docs, labels)
    kept = docs.drop("held_out", "score", "predicted")
    return kept.withColumns({"held_out": held_out(), "score": score(kept, model)}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


QUERIES = {"op5_quality_pu": op5_quality_pu}
ORACLES: dict[str, str] = {}
