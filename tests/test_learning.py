"""Label search and importance run with their operators' production parameters, and one scan scores as single scans do."""

from tidalframe.operators import labels, models, search
from tidalframe.plans import learning
from tidalframe.plans.labelling import _bars


def test_one_scan_scores_as_single_scans(spark, sf):
    bars = _bars(spark, sf)
    got = {tuple(r[:4]): r[4] for r in search.search(bars, 5, trials=3).collect()}
    part, want = search.subset(bars), {}
    for up, down, mult in search.candidates(3):
        n = max(1, int(5 * mult))
        for r in search.score(search.shares(labels.triple_barrier(part, 5, up, down, n), 5), 5).collect():
            want[(r["symbol"], up, down, n)] = r["score"]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_queries_try_100_candidates_and_50_trees(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(search, "candidates", lambda n, seed=42, f=search.candidates: seen.update(trials=n) or f(n, seed))
    monkeypatch.setattr(models, "importance", lambda *a, f=models.importance, **b: seen.update(trees=b["trees"]) or f(*a, **b))
    assert learning.label_search(spark, sf).count() > 0 and learning.feature_importance(spark, sf).count() == 6
    assert seen == {"trials": 100, "trees": 50}
