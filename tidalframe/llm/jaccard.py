"""N-gram Jaccard join: documents that share three quarters of their 5-word shingles.

Texts become sorted sets of shingle hashes.  Sets that are equal become one set.
Each set gives a tile row for every shingle of its prefix, in an order that puts
shingles found often last, and setjoin links the sets of a tile (size bands, parity
bitmaps, exact intersection).  The order of shingles is a choice that cannot
change the result: it uses the counts of the commonest HOT shingles, gathered from
all documents.

Defined cases: null or empty texts and texts without words have no shingles and
link with nothing; a text of one to four words is one shingle; repeated rows link;
a null id takes part, and a component's name is its smallest id that is not null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, setjoin
from .shingles import chunks, set_ids, sets_of, signatures, text_chunks

WORDS = 5
#: The commonest shingles that are ordered by count; the rest is ordered by hash.
HOT = 1 << 18
#: A shingle counts where so many of about _TOGETHER bytes of texts have it.
_LOCAL = 2
_TOGETHER = 8 << 20


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def hot_shingles(docs: DataFrame, words: int = WORDS, most: int = HOT) -> tuple[np.ndarray, DataFrame]:
    """At most so many of the commonest shingles, the commonest last: those that come up repeatedly within the batches of texts.

    Also a table (token, c) of those among them that come up in more than setjoin.HEAVY documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in text_chunks(b.column(0), _TOGETHER):
                parts = [sets_of(texts[lo:hi], words)[0] for lo, hi in chunks(texts)]
                x, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x[c >= _LOCAL]), "c": pa.array(c[c >= _LOCAL].astype(np.int64))})

    found = docs.select("text").mapInArrow(count, "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))
    found = common.stored(found.withColumn("level", F.floor(F.log2("c") * 8).cast("int")), "common-shingles", narrow=True)
    # As many whole levels of counts, from the top, as hold no more than `most`: a few hundred sums decide.
    level, held = None, 0
    for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        if held + r["n"] > most:
            break
        level, held = r["level"], held + r["n"]
    if level is None:
        return np.zeros(0, dtype=np.int64), found.limit(0).select(F.col("x").alias("token"), "c")
    heavy = found.where((F.col("level") >= level) & (F.col("c") > setjoin.HEAVY)).select(F.col("x").alias("token"), "c")
    rows = found.where(F.col("level") >= level).select("x", "c").toPandas().sort_values(["c", "x"])  # at most `most`
    return rows["x"].to_numpy(dtype=np.int64), heavy


def described(docs: DataFrame, hot: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, id, n, sig, prefix, key (a hash of the text) of every document; the prefix is empty where its batch holds an equal set before."""
    at = np.argsort(hot)
    hot_sorted, shipped = hot[at], docs.sparkSession.sparkContext.broadcast
    table = shipped((hot_sorted, at.astype(np.int64) + 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = table.value
        for b in batches:
            seen: set[int] = set()
            for lo, hi, texts in text_chunks(b.column(1)):
                x, n = sets_of(texts, words)
                ids = set_ids(x, n)
                place = np.zeros(len(x), dtype=np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    place = np.where(known[i] == x, rank[i], 0)
                owner = np.repeat(np.arange(len(n)), n)
                ordered = np.argsort(owner * (len(known) + 1) + place, kind="stable")
                take = setjoin.prefix_length(n)
                for k, sid in enumerate(ids.tolist()):
                    if sid in seen:
                        take[k] = 0
                    seen.add(sid)
                within = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                prefix = x[ordered][within < np.repeat(take, n)]
                sig, width = signatures(x, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(ids), pa.array(n), _lists(sig, width), _lists(prefix, take), b.column(2).slice(lo, hi - lo)],
                    names=["doc_id", "id", "n", "sig", "prefix", "key"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(describe, "doc_id long, id long, n long, sig array<long>, prefix array<long>, key long")


def join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    return components_of(docs, words).select("doc_id", "n_shingles", "component_id")


def components_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """join() with key (xxhash64 of the row's text) and comp, the component's name among sets (null without shingles)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Prefixes are as long as a quarter of the sets; they go to the tiles from a pass of their own and are not stored.
    hot, heavy = hot_shingles(docs, words)
    full = described(docs, hot, words)
    d = common.stored(full.select("doc_id", "id", "n", "sig", "key"), "shingle-sets")
    some = d.where("n > 0")
    sets = some.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = common.stored(sets, "distinct-sets")
    tokens = full.select(F.posexplode("prefix").alias("pos", "token"), "id", "n").select("token", "id", "n", "pos")
    n_tokens = some.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = ids.join(sets, "id").select(F.col("first_doc").alias("doc_id"))

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, texts in text_chunks(b.column(0)):
                    x, n = sets_of(texts, words)
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(x, n)), _lists(x, n)], names=["id", "x"])

        x = setjoin.maybe_in(docs, "doc_id", wanted).select("text").mapInArrow(shingled, "id long, x array<long>")
        return x.join(ids, "id", "left_semi")

    comps = common.stored(setjoin.linked(tokens, n_tokens, sets, fetch, heavy), "set-components", narrow=True)
    named = sets.select("id", "first_doc").join(comps, "id", "left").select("id", "first_doc", F.coalesce("comp", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    by_set = common.stored(named.join(least, "comp").select("id", "comp", "component_id"), "set-names")
    out = d.select("doc_id", "id", "n", "key").join(by_set, "id", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "key", "comp")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))


_ORACLE = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD}') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS x FROM w),
e AS (SELECT rid, unnest(x) AS t FROM s),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM e a JOIN e b USING (t) WHERE a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.rid = a JOIN s sb ON sb.rid = b WHERE {setjoin.DEN} * i >= {setjoin.NUM} * (len(sa.x) + len(sb.x) - i)),
r(rid, seen) AS (SELECT rid, rid FROM s UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.seen)
SELECT s.doc_id AS doc_id, len(s.x)::BIGINT AS n_shingles, c.component_id AS component_id
FROM s JOIN (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN s o ON o.rid = r.seen GROUP BY r.rid) c ON c.rid = s.rid"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {"op8_jaccard_join": _ORACLE}
