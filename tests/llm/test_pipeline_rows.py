"""Rows of a null id and of one repeated id that do not link are documents of their own."""

from collections import Counter

import corpus_pipeline as c
from tidalframe.llm import mixing

TEXT = [f"{w} speaks of {w} things that no other text in this table {w} mentions anywhere" for w in ("alpha", "beta", "gamma")]


def table(spark):
    rows = [(None, TEXT[0]), (None, TEXT[1]), (None, None), (None, None), (7, TEXT[2]), (7, TEXT[2]), (7, TEXT[2].replace("gamma", "delta")), (7, ""), (8, TEXT[2]), (None, TEXT[0])]
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_only_rows_that_link_are_merged(spark, tmp_path):
    got = Counter((r["doc_id"], r["text"]) for r in c.keep_one_of_each_group(spark, table(spark), str(tmp_path)).collect())
    assert got == Counter([(None, TEXT[0]), (None, TEXT[1]), (None, None), (None, None), (7, TEXT[2]), (7, TEXT[2].replace("gamma", "delta")), (7, "")])


def test_the_mix_takes_rows_and_not_ids(spark, tmp_path):
    docs = table(spark)
    taken = mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    out = c.mix_sources(spark, docs, str(tmp_path)).collect()
    assert sum(len(r["text"].split()) for r in out) == taken and {(r["doc_id"], r["text"]) for r in out} >= {(None, TEXT[0]), (None, TEXT[1])}
