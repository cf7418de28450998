"""The corpus pipeline: documents to packed training sequences.

STAGES are applied in order, each to the Parquet table that its predecessor left;
all but the last return the columns of documents.  ORACLE_SQL is None: the
quality model, the seeded order of the mix and the tokenizer have no SQL.

Defined cases of all stages: columns beyond those of documents are left out, whatever their names; an empty
table leaves an empty one; a null id or source is kept as it is; a text is worked on as a whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidalframe.llm import common, jaccard, mixing, packing, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    A null text is scored as an empty one; equal texts have equal scores, so repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one stays, a row of its smallest id; so do all rows without shingles.

    Null and empty texts have no shingles and stay, each row; a row without an id stays only where its component has no id at all;
    of repeated rows the one with the least text, language, source and length stays.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard.components_of(docs.select("doc_id", "text")).where("n_shingles > 0")
    # A row is known by its id and text: rows of one id, or of none, that do not link all stay.
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("s"))
    stay = common.stored(first.select(F.col("s.doc_id").alias("_stay"), F.col("s.key").alias("_text")), "stay")
    wordless = mixing.n_words(F.col("text")) == 0
    same = F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.xxhash64("text") == F.col("_text"))
    kept = docs.where(~wordless).join(stay, same, "left_semi").withColumn("_text", F.xxhash64("text"))
    # Equal rows of one id link with each other: one of them stays.
    one = kept.groupBy("doc_id", "_text").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return one.unionByName(docs.where(wordless))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the scan found in it is struck out.

    A null text stays null; rows in which nothing was found are unchanged, n_chars included; repeated rows are changed alike.
    """
    docs = docs.select(*COLUMNS)
    found = secrets.scan(docs).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("spans")))
    marked = docs.withColumn("blob", blob).join(common.small(common.stored(found, "found")), "blob", "left").withColumn("text", text)
    return marked.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words that it takes; documents that it leaves out go.

    Null and empty texts have no words and are never taken; repeated rows are documents of their own, and their takes are dealt
    out to them; a source may be null.
    """
    docs = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    mixed = mixing.mix(docs, extra=["_text", "source"])
    takes = F.when(F.col("taken") > 0, F.filter(F.array("first_pass", "second_pass"), lambda n: n > 0))
    # Rows of one id, text and source have their takes in one list, which is dealt out to them.
    mixed = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), F.col("source").alias("_s"), F.col("size").alias("_size")).agg(F.collect_list(takes).alias("_all"), F.count(F.lit(1)).alias("_rows"))
    mixed = common.stored(mixed.where(F.size("_all") > 0), "mix-takes")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))
    take = lambda m: docs.join(m.hint("shuffle_hash"), same)
    joined = take(mixed.where("_rows = 1")).withColumn("_takes", F.get("_all", F.lit(0)))
    equal = mixed.where("_rows > 1")
    if not equal.isEmpty():
        place = F.row_number().over(W.partitionBy("_id", "_t", "_s").orderBy("lang", "n_chars"))
        joined = joined.unionByName(take(equal).withColumn("_takes", F.get("_all", place - 1)))
    rows = joined.withColumn("_n", F.explode("_takes"))
    text = F.when(F.col("_n") < F.col("_size"), mixing.first_words(F.col("text"), F.col("_n"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.when(F.col("_n") < F.col("_size"), F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2,048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; a long text leaves as many full sequences as it fills.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", keep_one_of_each_group),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
