"""Repeated paragraphs against a brute-force search for repeated runs of words that ignores line breaks and paragraphs."""

import json
import random
import uuid
from collections import defaultdict

import numpy as np

from tests.llm.test_free import words_of
from tidalframe.llm import paragraphs

SIZE = paragraphs.LENGTH + 1


def windows_of(text, size=SIZE):
    w = words_of(text)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def held_by_two(rows, size=SIZE):
    where = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        for w in windows_of(t, size):
            where[w].add(k)
    return {w for w, d in where.items() if len(d) > 1}


def made(seed=3):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    rows, exact, long = [], fresh(SIZE), fresh(200)
    rows += [(1, lines(exact, 7)), (2, " ".join(fresh(300) + exact + fresh(300))), (3, lines(fresh(9) + exact + fresh(4), 11).upper())]
    rows += [(4, lines(long, 13)), (5, " ".join(fresh(30) + long[20:120] + fresh(30))), (6, lines(long[:99] + fresh(1) + long[100:], 10)), (7, "é \U0001f600 " + lines(long[60:], 9))]
    rows += [(8, " ".join(fresh(60) + long[:30])), (10, lines(fresh(400), 12)), (11, None), (12, "")]
    alone, twice, nobody = fresh(60), fresh(70), fresh(80)
    rows += [(13, " ".join(alone + fresh(5) + alone)), (14, " ".join(twice)), (14, " ".join(twice)), (None, lines(nobody, 8)), (None, " ".join(nobody + fresh(3))), (None, " ".join(fresh(60)))]
    for k in range(40):  # runs of just over LENGTH words at any place
        run = fresh(SIZE + k % 4)
        rows += [(100 + 2 * k, lines(fresh(k * 3 % 41) + run + fresh(17), 9)), (101 + 2 * k, " ".join(fresh(70 - k) + run + fresh(k)))]
    return rows


def test_runs_over_line_breaks_are_found(spark):
    rows = made()
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found, texts = defaultdict(list), dict(rows)
    for r in got:
        found[r["doc_id"]].append(r)
    assert {1, 2, 3, 4, 5, 6, 7, 14, None} <= set(found) and not set(found) & {8, 10, 11, 12, 13}
    assert len({i for i in found if i is not None and i >= 100}) >= 78
    assert all(not r["removed"] for r in found[1]) and all(any(r["removed"] and r["cluster_doc"] == 1 for r in found[i]) for i in (2, 3))
    for i, spans in found.items():
        if i in (None, 14):
            continue
        for r in spans:
            run = texts[i][r["start"] : r["start"] + r["length"]]
            assert run == run.strip() and len(words_of(run)) == r["words"] and r["line"] == texts[i][: r["start"]].count("\n")
    five = found[5]
    assert sum(r["words"] for r in five) >= 100 - 2 * paragraphs.OUT and all(r["cluster_doc"] == 4 for r in five)
    assert sorted(r["removed"] for r in found[14]) == [False, True]


def test_query_finds_runs_of_the_tables(spark, sf, table):
    from __spark_entry__ import queries

    sf = sf.replace("sf0.001", "sf0.01")
    import pyarrow.parquet as pq

    d = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    rows = list(zip(d.doc_id, d.text, strict=True))
    got = queries()["op3_paragraph_dedup"](spark, sf).collect()
    found = {r["doc_id"] for r in got}
    shared, less = held_by_two(rows), held_by_two(rows, 25)
    want = {i for i, t in rows if shared & set(windows_of(t))}
    clean = {i for i, t in rows if not less & set(windows_of(t, 25))}
    assert len(want & found) >= 0.99 * len(want) and len(clean & found) <= 0.01 * len(clean)
    stays = {i for i in {r["cluster_doc"] for r in got}}
    assert stays <= {r["doc_id"] for r in got if not r["removed"]}


def test_paragraphs_of_shared_runs_link():
    rng = np.random.default_rng(4)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    for _ in range(200):
        run = word(SIZE)
        texts = [" ".join(word(int(rng.integers(0, 60))) + run + word(int(rng.integers(0, 60)))) for _ in range(2)]
        p = paragraphs.Paragraphs(texts)
        x, n = p.sets(np.arange(len(p.id)))
        parts = np.split(x, np.cumsum(n)[:-1])
        best = max((len(np.intersect1d(parts[i], parts[j])) / len(np.union1d(parts[i], parts[j])) for i in np.flatnonzero(p.owner == 0) for j in np.flatnonzero(p.owner == 1) if p.anchor[i] == p.anchor[j]), default=0)
        assert best >= 0.75


def test_bands_find_likely_pairs():
    rng = np.random.default_rng(7)
    hits = 0
    for _ in range(300):
        run = [f"v{x}" for x in rng.integers(0, 10**8, 61)]
        other = run[:30] + ["odd"] + run[31:]
        p = paragraphs.Paragraphs([" ".join(run), " ".join(other)])
        k = paragraphs.bands()
        keys = p.bands(np.arange(len(p.id)), k, paragraphs.ROWS)
        pairs = [(i, j) for i in np.flatnonzero(p.owner == 0) for j in np.flatnonzero(p.owner == 1) if p.first[i] == p.first[j]]
        hits += any((keys[i] == keys[j]).any() for i, j in pairs) or not pairs
    assert hits >= 290 and 1 - (1 - 0.75**paragraphs.ROWS) ** paragraphs.bands() >= paragraphs.RECALL


def test_paragraphs_odd_rows(odd, none):
    got = paragraphs.repeated(odd).toPandas()
    assert set(got.doc_id) == {4, 5} and got.removed.sum() >= 1 and (got.cluster_doc == 4).all()
    assert paragraphs.repeated(none).count() == 0


def test_large_groups_of_an_anchor_link_alike(spark, monkeypatch):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    run, rows = fresh(70), []
    for k in range(60):
        body = list(run)
        if k % 3 == 0:
            body[rng.randrange(70)] = "edited"
        rows.append((k, " ".join(fresh(30) + body + fresh(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = []
    for group in (paragraphs.GROUP, 2):
        monkeypatch.setattr(paragraphs, "GROUP", group)
        of = defaultdict(set)
        for r in paragraphs.clusters(docs).collect():
            of[r["comp"]].add(r["id"])
        parts.append({frozenset(v) for v in of.values()})
    assert parts[0] == parts[1] and max(map(len, parts[0])) > 8


def test_a_candidate_is_taken_from_one_text_only(spark, monkeypatch, tmp_path):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    run, rows = fresh(400), []
    for k in range(48):
        body = list(run)
        body[rng.randrange(400)] = "edited"
        rows.append((k, " ".join(fresh(60) + body + fresh(60))))
    docs, link, at = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id"), paragraphs._links, str(tmp_path)

    def noted(batches):
        held = list(batches)
        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            json.dump([x for b in held for x in b.column(1).to_pylist()], f)
        yield from link(iter(held))

    monkeypatch.setattr(paragraphs, "_links", noted)
    found = {r["id"] for r in paragraphs.clusters(docs).collect()}
    sent = [x for f in tmp_path.iterdir() for x in json.loads(f.read_text())]
    assert len(sent) == len(set(sent)) > 50 and len(found & set(sent)) > 50
