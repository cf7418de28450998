"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks by hash, queries likewise, and every pair of a
candidate block and a query block is one group.  Within a group each dimension has
its list of candidates by value; a query walks all lists in step from the end that
its component's sign prefers, scores what it meets, and stops at the depth where
the sum of what the lists offer cannot reach its k-th score.  The blocks' winners
are few and are ranked once more.  A group holds about CANDIDATES candidates and QUERIES
queries, whatever the table's size.

Defined cases: vectors that are null or hold a null or non-finite component take no
part; a vector shorter than another has zeros in the missing places; ties go to the
smaller id, null ids last; rows with a query's own id are no candidates for it;
repeated query rows answer once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
SCALE = 256
QUERY_STEP = 50
CANDIDATES = 8_192
QUERIES_IN_BLOCK = 2_048
LEAST_BLOCKS = 24

#: Stands for a null id, which it orders last.
_NONE = int(np.iinfo(np.int64).max)


def threshold_search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each row of q the k best (score, id) among rows of x whose id is not own; whole numbers throughout."""
    c, d = x.shape
    exact = np.abs(x).max(initial=0) * float(np.abs(q).max(initial=0)) * max(d, 1) < 2**53
    kind = np.float64 if exact else np.int64
    x, q = x.astype(kind), q.astype(kind)
    up = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, up, axis=0)
    steps = sorted({min(c, max(1, c * s // 64)) for s in (1, 3, 7, 15, 24, 32, 48, 64)})
    # What all lists together still offer to each query below each depth.
    offer = [np.maximum(q, 0) @ values[c - t] + np.minimum(q, 0) @ values[t - 1] for t in steps]
    out = []
    for i in range(len(q)):
        down = q[i] >= 0
        seen = np.zeros(c, dtype=bool)
        best_s, best_i = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        before = 0
        for n, t in enumerate(steps):
            met = np.zeros(c, dtype=bool)
            met[up[c - t : c - before][:, down].ravel()] = True
            met[up[before:t][:, ~down].ravel()] = True
            new = np.flatnonzero(met & ~seen & (ids != own[i]))
            seen |= met
            before = t
            if len(new):
                s, j = np.concatenate([best_s, x[new] @ q[i]]), np.concatenate([best_i, ids[new]])
                if len(s) > 4 * k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    s, j = s[s >= cut], j[s >= cut]
                top = np.lexsort((j, -s))[:k]
                best_s, best_i = s[top], j[top]
            if len(best_s) == k and best_s[-1] > offer[n][i]:
                break
        out.append([(int(a), int(b)) for a, b in zip(best_s, best_i, strict=True)])
    return out


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries: vec_id, v (array<long>). query_id, rank, vec_id, score of the k best of vectors for each of queries."""
    n, nq = vectors.count(), queries.count()
    cb = max(LEAST_BLOCKS, -(-n // CANDIDATES))
    qb = max(1, -(-nq // QUERIES_IN_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).cast("int")
    named = F.coalesce("vec_id", F.lit(_NONE)).alias("vec_id")  # whole numbers stay whole in pandas
    cand = vectors.select(deal(cb).alias("cb"), every(qb).alias("qb"), F.lit(0).alias("is_query"), named, "v")
    ask = queries.select(every(cb).alias("cb"), deal(qb).alias("qb"), F.lit(1).alias("is_query"), named, "v")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, g["v"]))
        is_query = g["is_query"].to_numpy() == 1
        c, a = g[~is_query], g[is_query]
        own, ids = a["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        if not len(c) or not len(a):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = threshold_search(_matrix(c["v"], width), ids, _matrix(a["v"], width), own, k)
        return pd.DataFrame([(o, j, s) for o, best in zip(own.tolist(), found, strict=True) for s, j in best], columns=["query_id", "vec_id", "score"])

    near = cand.unionByName(ask).groupBy("cb", "qb").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(_NONE)).alias("vec_id"), "score")


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: each component x as floor(scale * x) in double arithmetic; vectors with null or non-finite components left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where(F.col("vec_id") % QUERY_STEP == 0).dropDuplicates(["vec_id", "v"]))


_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""

QUERIES = {"op6_threshold_topk": op6_threshold_topk}
ORACLES = {"op6_threshold_topk": _SQL}
