"""The adaptive search: better than chance on most seeds, the same on each run, scored as single scans are."""

import numpy as np

from tidalframe.operators import labels, search
from tidalframe.plans.labelling import _bars


def hill(x):
    """A score with one narrow top, in the ranges of the search."""
    top = np.array([1.1, 2.2, 2.3])
    return -(((x - top) / np.array([1.7, 1.7, 1.0])) ** 2).sum(axis=1)


def test_draws_beat_chance_on_most_seeds():
    won = 0
    for seed in range(30):
        rng = np.random.default_rng(seed)
        tried, scores = np.zeros((0, 3)), np.zeros(0)
        for _ in range(5):
            x = search.proposed(tried, scores, 20, rng)
            tried, scores = np.vstack([tried, x]), np.concatenate([scores, hill(x)])
        chance = search.proposed(np.zeros((0, 3)), np.zeros(0), 100, np.random.default_rng(1000 + seed))
        assert ((tried >= [0.8, 0.8, 2.0]) & (tried <= [2.5, 2.5, 3.0])).all()
        won += scores.max() > hill(chance).max()
    assert won >= 22


def test_adaptive_search_is_repeatable_and_scores_as_single_scans(spark, sf):
    bars = _bars(spark, sf)
    one = search.adaptive(bars, 5, trials=9, batch=4).orderBy("symbol", "trial").collect()
    two = search.adaptive(bars.repartition(7), 5, trials=9, batch=4).orderBy("symbol", "trial").collect()
    assert one == two and len(one) == 27 and [r.batch for r in one[:9]] == [0] * 4 + [1] * 4 + [2]
    part = search.subset(bars)
    for r in (one[0], one[13], one[26]):
        want = search.score(search.shares(labels.triple_barrier(part, 5, r.k_up, r.k_down, r.max_bars), 5), 5).where(f"symbol = '{r.symbol}'").first()
        assert abs(want.score - r.score) < 1e-9
    c = search.convergence(spark.createDataFrame(one)).orderBy("symbol", "batch").collect()
    a = [r for r in one if r.symbol == c[0].symbol]
    assert [r.trials for r in c[:3]] == [4, 8, 9]
    assert [r.best for r in c[:3]] == [max(x.score for x in a[:n]) for n in (4, 8, 9)] and c[0].gain == 0.0
    assert search.adaptive(bars.limit(0), 5, trials=3).count() == 0
