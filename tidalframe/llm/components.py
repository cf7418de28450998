"""Connected components of an edge table by star contraction.

Each round links every node's larger neighbours to the smallest of its
neighbourhood, then its smaller neighbours likewise, until all edges point to
the smallest node of their component.  Rounds grow with the logarithm of the
longest path.  A round is two aggregates and two joins by node; a hub of a
million edges is summed before the shuffle and its join partition can be split.
Each round is a table in the shared folder, so no lineage builds up and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """e: distinct (u, v) with u > v. Large: of both directions; small: from the larger node of each edge."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = both.where("v > u") if large else both
    moved = rows.join(least, "u")
    if large:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node itself and its other smaller neighbours
        out = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, comp): the smallest node reachable from each node that has an edge to another node."""
    e = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", narrow=True)
    known = None
    for _ in range(MAX_ROUNDS):
        e = common.stored(_stars(_stars(e, True), False), "stars", narrow=True)
        # All edges are stars once a round changes nothing: compare counts and an order-free checksum.
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == known:
            break
        known = mark
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
