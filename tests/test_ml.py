"""MLlib layer: invariants (the models are randomised or iterative, so no
oracle): augmentation clamps and sizes, probability simplex, prediction
columns, contributions additivity, persistence round trip."""

import hashlib
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import evaluate, logistic, ml
from riskflow.plans.pipeline import Portfolio

SF = "/root/testdata/sf0.001"
FEATS = ml.NOTEBOOK_FEATURES


@pytest.fixture(scope="module")
def sets(spark):
    p = Portfolio(spark, SF)
    sp = evaluate.time_split(p.featured)
    train = sp.filter("split = 'train'")
    enc = ml.fit_encodings(train)
    return (ml.apply_encodings(train, enc).cache(),
            ml.apply_encodings(sp.filter("split = 'test'"), enc).cache())


@pytest.fixture(scope="module")
def lr(sets):
    train, _ = sets
    aug = ml.append_synthetic(train, ml.augment_high(train, FEATS), FEATS).cache()
    return ml.fit_logistic(aug, FEATS, max_iter=100)


def test_augmentation_invariants(sets):
    train, _ = sets
    n_high = train.filter("next_risk_state = 'High'").count()
    syn = ml.augment_high(train, FEATS, seed=7)
    assert syn.count() == 4 * n_high
    bad = syn.filter(F.col("days_in_arrears") < 0).count()
    assert bad == 0
    # a copy of a row currently High stays in the High band
    base = ml.fill_features(train.filter("next_risk_state = 'High' AND risk_state = 'High'"), FEATS)
    if base.count():
        s2 = ml.augment_high(train.filter("risk_state = 'High'"), FEATS, seed=7)
        assert s2.filter((F.col("days_in_arrears") < 31) | (F.col("days_in_arrears") > 90)).count() == 0
    # seed-repeatable
    a = ml.augment_high(train, FEATS, seed=7).select(F.sum("days_in_arrears")).first()[0]
    b = ml.augment_high(train, FEATS, seed=7).select(F.sum("days_in_arrears")).first()[0]
    assert a == pytest.approx(b)
    flags = syn.filter(F.col("proj_will_be_default") != (F.col("projected_dpd_next") > 90).cast("double"))
    assert flags.count() == 0


def test_predictions_are_a_distribution(sets, lr):
    _, test = sets
    p = ml.predict_batch(lr, test)
    s = p.select((F.col("p_low") + F.col("p_medium") + F.col("p_high") + F.col("p_default")).alias("s"),
                 "pred", "p_pred", "p_high", "early_warning_high").collect()
    assert s and all(abs(r.s - 1) < 1e-9 for r in s)
    assert all(r.pred in ("Low", "Medium", "High", "Default") for r in s)
    assert all(r.early_warning_high == (r.p_high >= 0.25) for r in s)


def test_linear_contributions_reconstruct_logits(sets, lr):
    _, test = sets
    rows = test.limit(5)
    c = ml.linear_contributions(lr, rows, ["loan_id", "observation_month"])
    sums = c.groupBy("loan_id", "observation_month", "class").agg(F.sum("contribution").alias("s"))
    assert sums.count() == 5 * 4
    # softmax(sum + intercept) equals the model probability
    import math
    icpt = dict(zip(["Low", "Medium", "High", "Default"], lr.models[0].intercepts))
    probs = {(r.loan_id, r.observation_month): r for r in ml.predict_batch(lr, rows).collect()}
    by = {}
    for r in sums.collect():
        by.setdefault((r.loan_id, r.observation_month), {})[r["class"]] = r.s + icpt[r["class"]]
    for k, logits in by.items():
        z = sum(math.exp(v) for v in logits.values())
        assert math.exp(logits["High"]) / z == pytest.approx(probs[k].p_high, abs=1e-6)


def test_explain_and_importance(sets, lr):
    _, test = sets
    c = ml.linear_contributions(lr, test, ["loan_id", "observation_month"])
    top = ml.explain_top(c.filter("class = 'Default'"), ["loan_id", "observation_month"], n=5)
    assert top.groupBy("loan_id", "observation_month").count().filter("count > 5").count() == 0
    imp = ml.global_importance(c).collect()
    assert len(imp) == len(FEATS) and imp[0].importance >= imp[-1].importance
    labels = {r.feature: r.feature_label for r in imp}
    assert labels["days_in_arrears"] == "Days in arrears" and labels["dpd_delta"] == "dpd_delta"
    txt = ml.top_drivers_text(c, ["loan_id", "observation_month"]).first().top_drivers
    assert txt.count(" · ") == 2


def test_driver_direction(spark):
    df = spark.createDataFrame([("High", 1.0), ("High", -1.0), ("Low", 1.0), ("Low", -1.0)],
                               "pred string, contribution double")
    got = [r.direction for r in ml.driver_direction(df).collect()]
    assert got == ["increasing risk", "reducing risk", "supports healthy state", "minor factor"]


def test_save_load_roundtrip(spark, sets, lr):
    _, test = sets
    path = tempfile.mkdtemp(prefix="rf-model-") + "/m"
    ml.save_model(lr, path)
    back = ml.load_model(spark, path)
    a = ml.predict_batch(lr, test).select("loan_id", "observation_month", "p_high")
    b = ml.predict_batch(back, test).select("loan_id", "observation_month", "p_high")
    assert a.exceptAll(b).count() == 0 and back.features == lr.features


def test_saved_model_scores_a_raw_snapshot(spark, sets):
    from riskflow.plans.pipeline import Portfolio
    train, _ = sets
    p = Portfolio(spark, "/root/testdata/sf0.001")
    snap = p.rows.where("observation_month = '2001-06'")
    enc = ml.fit_encodings(p.rows.where("observation_month < '2001-06'"))
    for m in (ml.fit_logistic(train, ml.DEPLOYED_FEATURES), ml.fit_forest(train, ml.DEPLOYED_FEATURES, num_trees=3, max_depth=3),
              ml.fit_boosted(train, ml.DEPLOYED_FEATURES, rounds=2, depth=2)):
        m.encodings = enc
        path = tempfile.mkdtemp(prefix="rf-model-") + "/m"
        ml.save_model(m, path)
        cols = ["loan_id", "pred", *ml.PROB_COLS]
        a = ml.predict_snapshot(m, snap, p.rows).select(*cols)
        b = ml.predict_snapshot(ml.load_model(spark, path), snap, p.rows).select(*cols)
        whole = ml.apply_encodings(p.featured.where("observation_month = '2001-06'"), enc)
        c = ml.predict_batch(m, whole).select(*cols)
        got = [sorted(map(tuple, x.collect())) for x in (a, b, c)]
        assert got[0] and got[0] == got[1] == got[2]


def test_sample_and_noise_do_not_depend_on_partitioning(sets):
    train, _ = sets
    cols = ["loan_id", "observation_month"]
    a, b = (ml.sample_rows(train.repartition(n), 30).select(*cols) for n in (3, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    x, y = (ml.augment_high(train.repartition(n), ml.DEPLOYED_FEATURES).groupBy().sum("days_in_arrears").first()[0]
            for n in (3, 7))
    assert x == pytest.approx(y, rel=1e-12)


def test_forest_and_boosted_small(sets):
    train, test = sets
    rf = ml.fit_forest(train, ml.DEPLOYED_FEATURES, num_trees=5, max_depth=5)
    gb = ml.fit_boosted(train, ml.DEPLOYED_FEATURES, rounds=3, depth=3)
    for m in (rf, gb):
        s = ml.predict_batch(m, test).select(
            (F.col("p_low") + F.col("p_medium") + F.col("p_high") + F.col("p_default")).alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in s)


def test_newton_finds_the_optimum():
    # the same minimum from plain gradient descent on the same objective
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(300, 3)), np.ones(300)])
    y, w = rng.integers(0, 4, 300), rng.uniform(0.5, 2.0, 300)
    y[x[:, 0] > 1] = 2
    theta, loss, steps = logistic.minimise(lambda t, second: _reshaped(logistic.sums(x, y, w, t, second)), 4, 4, 1.0, 1e-9, 50)
    assert steps < 15
    penal = np.ones((4, 4))
    penal[:, -1] = 0.0
    plain_theta = np.zeros((4, 4))
    for _ in range(20_000):
        plain_theta -= 0.003 * (logistic.sums(x, y, w, plain_theta, False)[1] + penal * plain_theta)
    want = logistic.sums(x, y, w, plain_theta, False)[0] + 0.5 * (penal * plain_theta ** 2).sum()
    assert loss == pytest.approx(want, rel=1e-9) and loss <= want + 1e-9
    assert np.allclose(theta[:, :-1], plain_theta[:, :-1], atol=1e-5)


def _reshaped(found):
    loss, grad, hess = found
    return loss, grad, None if hess is None else hess.reshape(grad.size, grad.size), 1.0


def test_duckdb_scores_from_the_saved_tables(spark, sets, lr):
    _, test = sets
    path = tempfile.mkdtemp(prefix="rf-model-") + "/m"
    ml.save_model(lr, path)
    rows = ml.fill_features(test, FEATS).select("loan_id", "observation_month", *FEATS).toPandas()  # noqa: F841
    want = duckdb.sql(f"""
        WITH long AS (UNPIVOT rows ON {', '.join(FEATS)} INTO NAME feature VALUE x),
        coef AS (SELECT * FROM '{path}/model_0/*.parquet'),
        z AS (SELECT loan_id, observation_month, class, sum((x - mean) / std * coefficient) AS s
              FROM long JOIN coef USING (feature) GROUP BY ALL),
        e AS (SELECT loan_id, observation_month, z.class, exp(s + b.coefficient) AS v FROM z
              JOIN coef b ON b.class = z.class AND b.feature = '{logistic.INTERCEPT}')
        SELECT loan_id, observation_month, v / sum(v) OVER (PARTITION BY loan_id, observation_month) AS p
        FROM e QUALIFY class = 'High'""").fetchall()
    want = {(a, b): p for a, b, p in want}
    got = ml.predict_batch(ml.load_model(spark, path), test).select("loan_id", "observation_month", "p_high").collect()
    assert len(got) == len(want) and all(abs(want[r.loan_id, r.observation_month] - r.p_high) < 1e-9 for r in got)


def test_draws_with_replacement(spark, sets):
    train, _ = sets
    cols = ["loan_id", "observation_month", "row_seq"]
    high = train.filter("next_risk_state = 'High'").select(*cols)
    n = high.count()
    for parts in (2, 5):
        drawn = [tuple(r) for r in ml.draw_with_replacement(high.repartition(parts), 4).select("_draw", *cols).collect()]
        keys = sorted((hashlib.md5(f"42|{a}|{b}|{c}".encode()).hexdigest(), (a, b, c)) for a, b, c in map(tuple, high.collect()))
        want = [(i, *keys[int(hashlib.md5(f"42|draw|{i}".encode()).hexdigest()[:15], 16) % n][1]) for i in range(4 * n)]
        assert sorted(drawn) == sorted(want)


def test_sample_rows_exact_size(sets):
    train, _ = sets
    s = ml.sample_rows(train, 25, seed=3)
    assert s.count() == 25
    assert s.select("loan_id", "observation_month").distinct().count() == 25
