"""Collocations and spelling variants: against plain counting and plain edit distance, and odd rows."""

import glob
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe.llm import collocations, common, spelling


def plain_collocations(rows, least, longest=5, top=2000):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang or "und", text or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= c[p[i : i + k]]}
        rows = []
        for p, a in cand.items():
            if p not in drop:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def test_collocations_equal_plain_counts(spark, table):
    docs = table("documents")
    df = spark.createDataFrame([(x, t) for x, t in zip(docs.lang, docs.text, strict=True)], "lang string, text string")
    for least, top, size in ((6, 2000, 20_000), (40, 30, 1 << 20)):
        got = sorted(map(tuple, collocations.collocations(df.repartition(3), least=least, top=top, chunk_bytes=size).collect()))
        assert got == plain_collocations(zip(docs.lang, docs.text, strict=True), least, top=top) and len(got) > 20


def test_collocations_odd_rows(spark, odd, none):
    got = sorted(map(tuple, collocations.collocations(odd, least=2).collect()))
    assert got == plain_collocations([(r.lang, r.text) for r in odd.collect()], 2)
    assert {g[0] for g in got} >= {"en", "und"}
    assert collocations.collocations(none, least=2).count() == 0
    blank = odd.where("doc_id = 3").select("lang", "text")
    assert collocations.collocations(blank, least=1).count() == 0


def test_collocations_shuffle_where_names_are_many(spark, table, monkeypatch):
    docs = table("documents").head(60)
    df = spark.createDataFrame([(x, t) for x, t in zip(docs.lang, docs.text, strict=True)], "lang string, text string")
    monkeypatch.setattr(collocations, "NAMES", 0)
    got = sorted(map(tuple, collocations.collocations(df, least=8).collect()))
    assert got == plain_collocations(zip(docs.lang, docs.text, strict=True), 8)


def test_small_splits_share_chunks(spark, table):
    docs = table("documents")
    df = spark.createDataFrame([(x, t) for x, t in zip(docs.lang, docs.text, strict=True)], "lang string, text string").repartition(24)
    words = collocations.chunked(df).where("lid > 0")
    langs = words.select("lang").distinct().count()
    assert words.select("chunk").distinct().count() <= langs * spark.sparkContext.defaultParallelism
    assert words.agg(F.sum("n")).first()[0] == sum(n for *_, n in plain_counts(docs))


def most_held(f):
    """Bytes that f holds at most, of NumPy and of Arrow, and its result."""
    pool = pa.default_memory_pool()
    own = pa.proxy_memory_pool(pool)
    pa.set_memory_pool(own)
    tracemalloc.start()
    try:
        got = f()
        return tracemalloc.get_traced_memory()[1], own.max_memory(), got
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(pool)


def test_pairs_of_a_chunk_need_little_memory():
    r = np.random.default_rng(0)
    tokens = np.minimum(r.zipf(1.3, 4_000_000), 30_000).astype("<i4")
    tokens[::9] = 0
    lids = np.arange(1, 20_001)
    ids = r.permutation(50_000)[: len(lids)].astype(np.int64)
    held, _, (out, rank, left, right, n) = most_held(lambda: collocations._paired(tokens, lids, ids))
    assert held < 32 * len(tokens)
    known = np.concatenate([[-1], ids, np.full(10_000, -1)])[tokens]
    both = Counter(zip(known[:-1].tolist(), known[1:].tolist(), strict=True))
    want = {p: c for p, c in both.items() if min(p) >= 0}
    assert dict(zip(zip(left.tolist(), right.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert np.array_equal(np.bincount(out)[1:], n[np.argsort(rank)])


def test_levels_are_deleted_once_the_next_is_stored(spark, table):
    docs = table("documents").head(100)
    df = spark.createDataFrame([(x, t) for x, t in zip(docs.lang, docs.text, strict=True)], "lang string, text string")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    kept = lambda: {p for kind in ("words", "pairs", "hits") for p in glob.glob(f"{root}/{kind}-*")}
    before = kept()
    want = plain_collocations(zip(docs.lang, docs.text, strict=True), 8)
    got = collocations.collocations(df, least=8)
    new = kept() - before
    assert len(new) == 10 and all(spark.read.parquet(p).isEmpty() for p in new)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, got.collect())) == want


def test_frequent_words_are_named_once_and_found_in_each_chunk(spark, table):
    docs = table("documents").head(100)
    df = spark.createDataFrame([(x, t) for x, t in zip(docs.lang, docs.text, strict=True)], "lang string, text string")
    rows = common.stored(collocations.chunked(df, 20_000), "words")
    want = Counter()
    for lang, word, n in plain_counts(docs):
        want[lang, re.sub("[A-Z]", lambda m: m[0].lower(), word).encode()] += n
    want = {k: n for k, n in want.items() if n >= 8}
    chunks = {(r.lang, bytes(r.word), r.chunk, r.lid) for r in rows.where("lid > 0").collect()}
    got = collocations._hits(rows, ["lang", "word"], 8).collect()
    assert {(r.lang, bytes(r.word), r.chunk, r.lid) for r in got} == {c for c in chunks if c[:2] in want} and len(got) > len(want) > 20
    assert {(r.lang, bytes(r.word)): r.f for r in got} == want
    assert len({r.id for r in got}) == len({(r.lang, bytes(r.word), r.id) for r in got}) == len(want) == sum(r.first for r in got)


def plain_counts(docs):
    c = Counter((x or "und", w) for x, t in zip(docs.lang, docs.text, strict=True) for w in re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", t or ""))
    return [(*k, n) for k, n in c.items()]


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=0, max_size=6), min_size=1, max_size=40))
def test_automaton_numbers_and_near_words(found):
    words = sorted(found)
    a = spelling.Automaton(words)
    assert [a.place(w) for w in words] == list(range(len(words))) and a.place("zz") == -1
    for w in [*words, "abab"]:
        assert {words[i] for i in a.near(w)} == {v for v in words if distance_one(v, w)}


def plain_variants(n, times=10):
    near = {w: [v for v in n if v != w and distance_one(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=4, max_size=9), st.sampled_from([2, 20, 21, 300, 4000]), min_size=1, max_size=150))
def test_split_keys_lose_and_repeat_nothing(spark, n):
    df = common.stored(spark.createDataFrame(sorted(n.items()), "word string, n long"), "vocabulary")
    for group in (3, 10_000):
        assert sorted(map(tuple, spelling.variants(df, shortest=4, group=group).collect())) == plain_variants(n)


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_words_and_odd_rows(spark, odd, none):
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, f"Ünïcodeé wordÀÿx {'q' * 4000} variantes varianteS variante") for i in range(80)], "doc_id long, text string"))
    want = plain_words([tuple(r) for r in more.collect()])
    vocabulary = common.stored(spelling.words(more), "vocabulary")
    assert {r.word: r.n for r in vocabulary.collect()} == want
    got = sorted(map(tuple, spelling.variants(vocabulary).collect()))
    assert got == plain_variants(want) and any(g[1] for g in got)
    assert spelling.variants(common.stored(spelling.words(none), "vocabulary")).count() == 0


def test_queries_of_words_equal_plain_versions(spark, sf, table):
    docs = table("documents")
    want = plain_words(zip(docs.doc_id, docs.text, strict=True))
    got = spelling.op12_spelling_variants(spark, sf).where(F.col("form").isNotNull()).count()
    assert got == sum(1 for w in plain_variants(want) if w[1])
