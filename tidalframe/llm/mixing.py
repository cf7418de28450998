"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's words are cut into blocks of equally many words.  The blocks of
the mix are apportioned to the sources by highest quotients target / (2k + 1),
each source's blocks likewise to its shards by the shards' words, and each shard
fills its quota with blocks in a seeded order of its documents; a shard whose
quota exceeds its blocks starts over, so words repeat at most as often as the
source's cap allows.

Main path: DataFrame functions alone.  A source that holds a third of all rows is
dealt out to shards of about SHARD_ROWS documents before anything is ordered, by a hash of
id and text; rows of one id and text beyond SHARD_ROWS are numbered and dealt out by
their number, too.  So no window holds more than about a shard; tables by source or
by shard are small sums.

Defined cases: a null text has no words; a null source is a source of its own,
ordered last; documents without words take nothing; an empty table gives an empty
result; repeated rows are separate documents, rows of one id (or of none) are ordered by
a hash of their text; ties of quotients go to the smaller source or shard; a text is
counted as a whole, in memory that grows with its own length; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 16
SHARD_ROWS = 4096
SEED = 17


def apportion(parties: DataFrame, by: list[str], weight: str, total: str, key: list[str], seats: str) -> DataFrame:
    """parties with a column of whole seats: in each group of `by`, the `total` seats go one by one to the highest quotient weight / (2k + 1), ties to the smaller key.

    A divisor that gives all seats lies within n / (2 total) of total / weights,
    for n parties, so only about 3 n quotients a group need ranking; all lower
    ones are certain to win.
    """
    g = W.partitionBy(*by)
    n = F.count(F.lit(1)).over(g)
    quota = F.when(F.sum(weight).over(g) > 0, F.col(total) * F.col(weight) / F.sum(weight).over(g)).otherwise(F.lit(0.0))
    p = parties.withColumns({"_q": quota, "_slack": F.when(F.col(total) > 0, n / (2 * F.col(total))).otherwise(F.lit(0.0))})
    p = p.withColumns(
        {
            "_low": F.greatest(F.lit(0).cast("long"), F.ceil(F.col("_q") * (1 - F.col("_slack")) - 0.5) - 1),
            "_high": F.when(F.col("_q") > 0, F.floor(F.col("_q") * (1 + F.col("_slack")) + 0.5) + 1).otherwise(F.lit(0).cast("long")),
        }
    )
    p = p.withColumn("_left", F.col(total) - F.sum("_low").over(g))
    tried = p.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    place = F.row_number().over(W.partitionBy(*by).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc_nulls_last(), *key))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in parties.columns]
    return tried.withColumn("_place", place).groupBy(*keep, "_low").agg(won.alias("_won")).select(*keep, (F.col("_low") + F.col("_won")).cast("long").alias(seats))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, source_rows), one row a source, with target: share of all words by weight, none above cap times its size, the excess shared anew.

    Rows of this table are sources, so its windows over all of it are narrow.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"_cap": F.col("source_size") * F.lit(cap), "_r": F.col("source_size") * F.lit(cap) / F.col("_w")})
    up = W.orderBy("_r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_level", (F.sum("source_size").over(W.partitionBy()) * share - before) / rest)
    # The water level: that of the first source, by cap over weight, which the level does not fill.
    s = s.withColumn("_fill", F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "_level"))).over(W.partitionBy())["_level"])
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_fill"), F.col("_cap")))).drop("_w", "_cap", "_r", "_level", "_fill")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def _overlap(start: Column, end: Column, upto: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, upto) - start)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (a stored table) with _number, from 0 within the rows of equal keys: by task, then within it."""
    rows = rows.withColumn("_pid", F.spark_partition_id())
    same = lambda a, b: [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    counts = rows.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_pid")) - F.col("_n")
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_k_pid"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy(*keys, "_pid").orderBy("_pid")) - 1
    joined = rows.withColumn("_place", place).join(counts, [*same(rows, counts), F.col("_pid") == F.col("_k_pid")])
    return joined.withColumn("_number", F.col("_before") + F.col("_place")).select(*[c for c in rows.columns if c != "_pid"], "_number")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED, extra: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_pass, second_pass and the columns `extra` for every document.

    taken = first_pass + second_pass words: those of the first and of the second round over its shard.
    """
    extra = extra or []
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_key"), *[c for c in extra if c != "source"])
    sized = common.stored(sized, "mix-sizes")
    row = ["doc_id", "_key", "source"]
    many = sized.groupBy(*row).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SHARD_ROWS).select(*[F.col(c).alias(f"_m{c}") for c in row])
    salt = F.lit(0).cast("long")
    if not many.isEmpty():
        own = [F.col(c).eqNullSafe(F.col(f"_m{c}")) for c in row]
        held = sized.join(common.small(common.stored(many, "mix-repeats", narrow=True)), own, "left_semi")
        rest = sized.join(common.small(many), own, "left_anti")
        sized = rest.withColumn("_number", salt).unionByName(_numbered(common.stored(held, "mix-repeated"), row))
        sized = common.stored(sized, "mix-numbered")
    else:
        sized = sized.withColumn("_number", salt)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    aimed = source_targets(by_source, weights, share, cap)
    aimed = aimed.withColumns({"_all": F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"), "_one": F.lit(1), "n_shards": F.ceil(F.col("source_rows") / SHARD_ROWS)})
    aimed = common.stored(apportion(aimed, ["_one"], "target", "_all", [F.col("source").asc_nulls_last()], "source_blocks"), "mix-sources", narrow=True)
    side = common.small(aimed.select(F.col("source").alias("_source"), "source_size", "target", "n_shards", "source_blocks"))
    order = F.xxhash64(F.lit(seed), common.id_text("doc_id"))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), common.id_text("doc_id"), "_key", "_number"), F.col("n_shards"))
    dealt = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumns({"_order": order, "_shard": shard}).drop("_source")
    shards = dealt.groupBy("source", "_shard", "source_blocks").agg(F.sum("size").alias("_words"))
    quotas = apportion(shards, ["source"], "_words", "source_blocks", ["_shard"], "_blocks")
    quotas = common.stored(quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "_words", "_blocks"), "mix-quotas", narrow=True)
    line = W.partitionBy("source", "_shard").orderBy("_order", "doc_id", "_key")
    end = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    laid = dealt.withColumn("_end", end).join(common.small(quotas), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")))
    words = F.col("_blocks") * block
    once, twice = F.least(words, F.col("_words")), F.least(F.greatest(words - F.col("_words"), F.lit(0)), F.col("_words"))
    start = F.col("_end") - F.col("size")
    laid = laid.withColumns({"first_pass": _overlap(start, F.col("_end"), once), "second_pass": _overlap(start, F.col("_end"), twice)})
    return laid.select("doc_id", "size", "source_size", "target", (F.col("first_pass") + F.col("second_pass")).alias("taken"), "first_pass", "second_pass", *extra)


def first_words(text: Column, n: Column) -> Column:
    """The first n words of text with what stands before and between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{common.WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).drop("first_pass", "second_pass")


QUERIES = {"op4_source_mix": op4_source_mix}
ORACLES: dict[str, str] = {}
