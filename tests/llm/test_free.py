"""The operators with Python stages: brute force, exact round trips or held-out accuracy, and the odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe.llm import common, components, jaccard, language, packing, quality, setjoin, sharding, shingles, topk


def held(ids, k, r):
    return [zlib.crc32(str(i).encode()) % k == r for i in ids]


def test_quality_on_held_out_labels(spark, sf):
    import pyarrow.parquet as pq

    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold out three bad documents
    table = lambda name: pq.read_table(f"{sf}/{name}.parquet").to_pandas()
    got = quality.op5_quality_pu(spark, sf).toPandas()
    assert len(got) == len(table("documents")) and list(got.held_out) == held(got.doc_id, 4, 2)
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    m = got.merge(table("labels"), on="doc_id")
    assert ((m.predicted == m.quality)[m.held_out]).mean() > 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        out = quality.classify(odd, lab).toPandas()
        assert len(out) == odd.count() and out.score.between(0, 1).all() and out.held_out.dtype == bool
    assert quality.classify(none, labels).count() == 0


def test_nnpu_finds_the_class_without_negatives():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (1200, 3))
    m = quality.fit_nnpu(pos[:2000], np.vstack([pos[2000:], neg[:600]]), 2000 / 2600)
    assert (m.scores(pos) > 0.5).mean() > 0.95 and (m.scores(neg[600:]) < 0.5).mean() > 0.9
    assert abs(quality.estimated_prior(pos[:2000], np.vstack([pos[2000:], neg[:600]])) - 2000 / 2600) < 0.15


def brute_topk(x, ids, q, own, k):
    s = sorted(((int(a @ q), i) for a, i in zip(x.tolist() and x, ids, strict=True) if i != own), key=lambda t: (-t[0], t[1]))
    return s[:k]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 60), st.integers(1, 6), st.booleans())
def test_threshold_search_is_exact(seed, n, d, ties):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3 if ties else -300, 4 if ties else 300, (n, d))
    ids = rng.permutation(n)
    q = rng.integers(-3, 4, (4, d))
    own = np.array([0, 1, -7, n - 1])
    assert topk.threshold_search(x, ids, q, own, 5) == [brute_topk(x, ids, a, o, 5) for a, o in zip(q, own, strict=True)]


def test_topk_query_equals_brute_force(spark, sf, table):
    got = topk.op6_threshold_topk(spark, sf).toPandas()
    e = table("embeddings")
    x = np.floor(256 * np.stack(e.embedding).astype(float)).astype(np.int64)
    want = {(i, r + 1, j, s) for q, i in zip(x, e.vec_id, strict=True) if i % 50 == 0 for r, (s, j) in enumerate(brute_topk(x, e.vec_id, q, i, 5))}
    assert set(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == want


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [1.0, float("nan")]), (52, None), (53, [1.0, None]), (54, [float("inf"), 0.0]), (55, [3.0]), (None, [1.0, 2.0]), (0, [1.0, 2.0]), (56, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    v = topk.quantized(df)
    out = topk.top_k(v, v.where(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id", "v"])).orderBy("query_id", "rank").toPandas()
    first = out[out.query_id == 0]
    assert first.vec_id.tolist()[0] == 50 and pd.isna(first.vec_id.tolist()[1]) and first.vec_id.tolist()[2:4] == [55, 56]
    assert first.score.tolist()[:4] == [256**2 + 512**2] * 2 + [256 * 768, 0]
    assert set(out.query_id) == {0, 50} and not set(out.vec_id.dropna()) & {51, 52, 53, 54}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_language_on_held_out_rows(spark, sf, table):
    got = language.op7_language_filters(spark, sf).toPandas()
    assert list(got.held_out) == held(got.doc_id, 5, 0) and got.score.between(0, 1).all()
    m = got.merge(table("documents"), on="doc_id")
    assert len(m) == len(table("documents")) and (m.lang == m.lang_pred)[m.held_out & m.lang.notna()].mean() > 0.97


def test_language_odd_rows(odd, none):
    model = language.learn(odd.where("lang is not null"))
    out = odd.select("doc_id", "text", language.predict(odd, model).alias("p")).select("doc_id", "text", "p.*").toPandas()
    letters = [bool(t) and any(c.isalpha() for c in t) for t in out.text]
    assert [p != "und" for p in out.lang_pred] == letters and (out.score[[not x for x in letters]] == 0).all()
    empty = language.learn(none)
    assert set(odd.select(language.predict(odd, empty).alias("p")).toPandas().p.map(lambda r: r["lang_pred"])) == {"und"}


def test_bit_sliced_lookup_returns_all_languages():
    grams = np.arange(5000, dtype=np.int64) * 7919
    kept = pd.DataFrame({"lang": ["a"] * 3000 + ["b"] * 3000, "gram": np.concatenate([grams[:3000], grams[2000:]])})
    m = language.build(kept, 1 << 16)
    bits = m.masks(grams)[:, 0].astype(np.int64)
    assert (bits[:3000] & 1).all() and ((bits[2000:] >> 1) & 1).all()
    assert abs((bits[3000:] & 1).mean() - m.false[0]) < 0.01


def words_of(t):
    return re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(w, k=5):
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(sets):
    """Of each key the smallest key reachable by links; keys in order."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        for t in s:
            where[t].append(k)
    for a, b in {(a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :]}:
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in sets}


def test_jaccard_equals_brute_force(spark, sf, table):
    got = jaccard.op8_jaccard_join(spark, sf).toPandas()
    d = table("documents")
    sets = {i: shingle_set(words_of(t)) for i, t in zip(d.doc_id, d.text, strict=True)}
    comp = brute_components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == {i: (len(s), comp[i]) for i, s in sets.items()}


def near_copies(seed, groups=6, size=40):
    """Texts of groups with every grade of likeness, and unlike ones that share a passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(int(rng.integers(6, 120)))]
        for _ in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, max(1, len(t) // 12) + 1))):
                t[int(rng.integers(0, len(t)))] = word()
            out.append(" ".join(t))
        out += [" ".join([*passage, *[word() for _ in range(20)]]) for _ in range(10)]
    return out


@pytest.mark.parametrize("seed,block,best,heavy", [(1, 2048, 2, 250_000), (2, 7, 2, 250_000), (3, 11, 1, 5)])
def test_jaccard_of_large_groups_loses_no_link(spark, monkeypatch, seed, block, best, heavy):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "HEAVY", heavy)
    monkeypatch.setattr(setjoin, "BEST", best)
    monkeypatch.setattr(setjoin, "GROW", 256 if best > 1 else 16)
    texts = near_copies(seed)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(d).collect()}
    assert got == brute_components({i: shingle_set(words_of(t)) for i, t in enumerate(texts)})


def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(80)], []
    for _ in range(800):
        t = list(base)
        for i in rng.integers(0, len(t), int(rng.integers(1, 5))):
            t[i] = f"v{rng.integers(0, 10**6)}"
        texts.append(" ".join(t))
    given_, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, narrow=False: given_.append((name, stored(df, name, narrow))) or given_[-1][1])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(d).collect()}
    assert sum(df.count() for name, df in given_ if name in ("tried", "tried-next")) < 10 * len(texts)
    assert got == brute_components({i: shingle_set(words_of(t)) for i, t in enumerate(texts)})


def test_jaccard_odd_rows(odd, none):
    out = jaccard.join(odd).toPandas()
    assert len(out) == odd.count()
    by = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.n_shingles[[1, 2, 3]].tolist() == [0, 0, 0] and by.component_id[[1, 2, 3]].tolist() == [1, 2, 3]
    assert by.component_id[[4, 5]].tolist() == [4, 4] and by.n_shingles[7] == 1
    assert jaccard.join(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \n\t\x0b.é\U0001f600 ", max_size=40), max_size=6))
def test_shingle_hashes_name_shingles(texts):
    x, n = shingles.sets_of(texts)
    parts = np.split(x, np.cumsum(n)[:-1]) if len(n) else []
    want = [shingle_set(words_of(t)) for t in texts]
    assert [len(p) for p in parts] == [len(w) for w in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(np.intersect1d(parts[i], parts[j])) == len(a & b)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 900), st.integers(1, 900), st.integers(0, 900))
def test_signatures_bound_the_overlap(seed, a, b, both):
    rng = np.random.default_rng(seed)
    both = min(a, b, both)
    x = rng.integers(-(2**63), 2**63 - 1, a + b - both)
    s, t = np.sort(x[:a]), np.sort(x[a - both :])
    flat, words = shingles.signatures(np.concatenate([s, t]), np.array([len(s), len(t)]))
    apart = shingles.bits_apart(flat, np.cumsum(words) - words, words, np.array([0]), np.array([1]))[0]
    assert apart <= len(s) + len(t) - 2 * len(np.intersect1d(s, t))


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
    assert components.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def check_pieces(got, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    left = defaultdict(int)
    for i, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for r in got[(got.doc_id == i) if i is not None else got.doc_id.isna()].itertuples():
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.doc_tokens == len(ids)
            if zlib.crc32(part.tobytes()) == r.ids_crc32:
                left[(i, x)] += r.length
    s = got.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    assert s.groupby("sequence_id").length.sum().max() <= capacity
    return left


def test_packing_round_trip(spark, sf, table):
    got = packing.op9_cost_packing(spark, sf).toPandas()
    d = table("documents")
    left = check_pieces(got, list(zip(d.doc_id, d.text, strict=True)))
    tokens = got.drop_duplicates("doc_id").set_index("doc_id").doc_tokens
    assert all(left[(i, t)] == tokens[i] for i, t in zip(d.doc_id, d.text, strict=True))
    assert got.length.sum() / (got.sequence_id.nunique() * packing.CAPACITY) > 0.98
    assert got.groupby("doc_id").length.sum().eq(tokens).all()


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, group_rows=3).toPandas()
    check_pieces(got, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert got[got.doc_id == 1].values.tolist()[0][1:5] == [0, 1, zlib.crc32(b"\x01\0\0\0"), 1]
    assert (got[got.doc_id == 4].length.sum()) == 2 * got[got.doc_id == 5].length.sum()
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fast_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own = Tokenizer.from_file(path)
    for t in (text, text + "<|endoftext|>" + text, "  \n\n " + text + "\t 's"):
        t = t.encode("utf-8", "replace").decode()
        assert packing._encoder(path)(t) == own.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_assignment_fills_sequences(lengths):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    rows = packing.assign(lengths, 100)
    got = defaultdict(list)
    for i, start, n, s, off in rows:
        got[s].append((off, n))
    for v in got.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 100
    assert sum(r[2] for r in rows) == lengths.sum() and len(got) <= -(-int(lengths.sum()) // 100)


def test_placement_table(spark, sf, odd, none):
    t = sharding.lookup_table(sharding.SHARDS)
    n = np.bincount(t)
    assert len(t) == sharding.SLOTS and n.max() - n.min() <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = (t != less) & (t != len(sharding.SHARDS) - 1)
    assert moved.mean() < 0.05
    small = sharding.lookup_table(["a", "b", "c"], 7)
    assert sorted(np.bincount(small)) == [2, 2, 3]
    got = sharding.op10_shard_placement(spark, sf).toPandas()
    assert len(got) == got.doc_id.nunique() and (t[got.slot] == got.shard).all()
    out = sharding.place(odd).toPandas()
    assert len(out) == odd.count() and out[out.doc_id == 4].shard.nunique() == 1
    assert sharding.place(none).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_pipeline_equals_its_parts(spark, sf, table):
    import corpus_pipeline as c

    d = table("documents")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("spans", F.lit("clash"))
    kept = common.stored(c.keep_quality(spark, docs, sf), "t")
    assert kept.columns == c.COLUMNS
    good = quality.op5_quality_pu(spark, sf).where("predicted = 1").toPandas().doc_id
    assert set(kept.toPandas().doc_id) == set(good)
    one = common.stored(c.keep_one_of_each_group(spark, kept, sf), "t")
    texts = {i: t for i, t in zip(d.doc_id, d.text, strict=True) if i in set(good)}
    comp = brute_components({i: shingle_set(words_of(t)) for i, t in texts.items()})
    assert sorted(one.toPandas().doc_id) == sorted(set(comp.values()))
    clean = common.stored(c.redact_secrets(spark, one, sf), "t")
    from tests.llm.test_native import spans

    for r in clean.collect():
        assert not spans(r["text"]) and (r["text"] == texts[r["doc_id"]] or spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    mixed = common.stored(c.mix_sources(spark, clean, sf), "t")
    n = lambda t: len(re.findall(common.WORD, t or ""))
    took = defaultdict(int)
    for r in mixed.collect():
        took[r["doc_id"]] += n(r["text"])
    from tidalframe.llm import mixing

    assert dict(took) == {r["doc_id"]: r["taken"] for r in mixing.mix(clean).where("taken > 0").collect()}
    packed = c.pack_sequences(spark, mixed, sf).toPandas()
    check_pieces(packed, [])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert packed.length.sum() == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())


def mixing_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_stages_take_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(4, 1, 0), (8, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in c.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == c.COLUMNS or name == "pack"
        rows = out.collect()
        before = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect())
        if name in ("quality", "near-duplicates"):  # rows as they were, each at most as often
            assert rows and not Counter(map(tuple, rows)) - before
        elif name == "mix":  # beginnings of texts with words, two of each at most
            texts = Counter((r.doc_id, r.source) for r in odd.collect() for _ in range(2) if mixing_words(r.text))
            assert rows and not Counter((r.doc_id, r.source) for r in rows) - texts
            whole = {}
            for r in odd.collect():
                whole.setdefault(r.doc_id, []).append(r.text or "")
            assert all(any(t.startswith(r.text) for t in whole[r.doc_id]) for r in rows)
        elif name == "pack":  # every token of every row in one piece, without gaps in a sequence
            assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0) and sum(r.start == 0 for r in rows) == odd.count()
            ends = {}
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= packing.CAPACITY
    one = c.keep_one_of_each_group(spark, odd, str(tmp_path)).toPandas()
    assert (one.doc_id == 4).sum() == 1 and not (one.doc_id == 5).any() and {1, 2, 3} <= set(one.doc_id.dropna())
    assert len(c.redact_secrets(spark, odd, str(tmp_path)).toPandas()) == odd.count()
