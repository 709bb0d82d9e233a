"""Boosted trees against a plain booster that looks at every row for every cut."""

import numpy as np
import pytest

from riskflow.operators import boosting, ml

FEATURES = ["a", "b", "c"]
CUTS = [np.array([1.0, 2.0, 3.0]), np.array([0.25, 0.5]), np.array([7.0])]


def _rows(n=400):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 5, n).astype(float), rng.uniform(size=n).round(2), np.full(n, 7.0)])
    y = ((x[:, 0] > 2).astype(int) + 2 * (x[:, 1] > 0.5)).astype(int)
    y[rng.uniform(size=n) < 0.2] = 3
    return x, y, rng.uniform(0.5, 2.0, n).round(3)


def _table(spark, x, y, w, parts=1):
    rows = [(*map(float, r), int(k), float(v)) for r, k, v in zip(x, y, w)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int, weight double").coalesce(1) \
        .repartition(parts) if parts > 1 else spark.createDataFrame(
            rows, "a double, b double, c double, label int, weight double").coalesce(1)


def _plain(x, y, w, rounds, depth, rate, subsample, colsample, seed):
    """Scores of all rows after every round, one row set after the other."""
    score = np.zeros((len(x), 4))
    for number in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        take = boosting.drawn(np.arange(len(x)), number, seed, subsample)
        new = score.copy()
        for c in range(4):
            g, h = (p[:, c] - (y == c)) * w, 2 * p[:, c] * (1 - p[:, c]) * w
            allowed = boosting.columns_of(number, c, seed, colsample, x.shape[1])

            def grow(rows, left_levels):
                mine = rows & take
                sum_g, sum_h = g[mine].sum(), h[mine].sum()
                best = (1e-6, None)
                for f in allowed if left_levels else ():
                    for cut in CUTS[f]:
                        low, high = mine & (x[:, f] <= cut), mine & (x[:, f] > cut)
                        if h[low].sum() < 1 or h[high].sum() < 1:
                            continue
                        gain = (g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
                                - sum_g ** 2 / (sum_h + 1))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
                if best[1] is None:
                    new[rows, c] += -sum_g / (sum_h + 1) * rate
                    return
                f, cut = best[1]
                grow(rows & (x[:, f] <= cut), left_levels - 1)
                grow(rows & (x[:, f] > cut), left_levels - 1)

            grow(np.ones(len(x), bool), depth)
        score = new
    return score


@pytest.mark.parametrize("subsample, colsample", [(1.0, 1.0), (0.8, 0.7)])
def test_boosted_equals_plain_booster(spark, subsample, colsample, monkeypatch):
    monkeypatch.setattr(boosting, "STAGE_ROUNDS", 2)      # scores are written anew on the way
    x, y, w = _rows()
    model = boosting.fit(_table(spark, x, y, w), FEATURES, rounds=5, depth=3, learning_rate=0.3,
                         subsample=subsample, colsample=colsample, seed=9, cuts=CUTS)
    want = _plain(x, y, w, 5, 3, 0.3, subsample, colsample, 9)
    got = model.margins(x)
    assert np.allclose(got, want, atol=1e-5)
    loss = [-np.log(boosting.softmax(s)[np.arange(len(y)), y]).mean() for s in (got, np.zeros_like(got))]
    assert loss[0] < loss[1]


def test_trees_do_not_depend_on_partitioning(spark):
    x, y, w = _rows(150)
    a, b = (boosting.fit(_table(spark, x, y, w, n), FEATURES, rounds=2, depth=3, subsample=1.0, bins=16) for n in (1, 5))
    assert a == b


def test_scoring_in_spark_and_from_the_table(spark):
    x, y, w = _rows(120)
    t = _table(spark, x, y, w)
    model = boosting.fit(t, FEATURES, rounds=2, depth=2, bins=8)
    back = boosting.from_table(boosting.to_table(model, spark), FEATURES)
    assert np.array_equal(model.margins(x), back.margins(x))
    got = np.array([list(r) for r in boosting.probabilities(t, model, ml.PROB_COLS).select(*ml.PROB_COLS).collect()])
    assert np.allclose(got, boosting.softmax(model.margins(x)), atol=1e-12)


def test_empty_and_constant_tables(spark):
    empty = spark.createDataFrame([], "a double, b double, c double, label int, weight double")
    model = boosting.fit(empty, FEATURES, rounds=2, depth=2, bins=4)
    assert not model.margins(np.zeros((2, 3))).any()
    x = np.full((20, 3), 1.5)
    model = boosting.fit(_table(spark, x, np.arange(20) % 2, np.ones(20)), FEATURES, rounds=1, depth=3, bins=4)
    assert all(len(t.left) == 1 for t in model.rounds[0])


def test_quantile_cuts(spark):
    t = spark.range(1000).selectExpr("cast(id as double) as a", "1.0D as b")
    a, b = boosting.quantile_cuts(t, ["a", "b"], 4)
    assert np.allclose(a, [249, 499, 749], atol=2) and list(b) == [1.0]
    with pytest.raises(ValueError):
        boosting.quantile_cuts(t, ["a"], 257)
