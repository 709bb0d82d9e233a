"""Golden values: the reference's published count matrix fed through our
operators must reproduce its published P, P^n, absorption and forecast files."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators import markov, transitions
from riskflow.states import STATES

# The reference's transition counts (rows From, columns To; Low, Medium, High, Default).
GOLDEN_COUNTS = [
    [40695, 2323, 124, 125],
    [1728, 6759, 1040, 9],
    [0, 446, 3190, 1040],
    [5, 9, 3, 6160],
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(STATES[i], STATES[j], n) for i in range(4) for j in range(4) for n in [GOLDEN_COUNTS[i][j]]]
    df = spark.createDataFrame(rows, "risk_state string, next_risk_state string, n int")
    return df.select("risk_state", "next_risk_state", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_"))


@pytest.fixture(scope="module")
def P(pairs):
    return transitions.transition_matrix_packed(pairs).cache()


def cell(long_df, a, b, col="p"):
    return long_df.filter((F.col("from_state") == a) & (F.col("to_state") == b)).first()[col]


def test_counts_roundtrip(pairs):
    c = transitions.transition_counts(pairs)
    assert c.agg(F.sum("n_pairs")).first()[0] == 63656
    assert cell(c, "High", "Default", "n_pairs") == 1040


def test_one_month_matrix(P):
    long = transitions.to_long(P)
    assert cell(long, "Low", "Low") == pytest.approx(0.940555, abs=1e-6)
    assert cell(long, "Medium", "Low") == pytest.approx(0.181208, abs=1e-6)
    assert cell(long, "High", "Default") == pytest.approx(0.222412, abs=1e-6)
    assert cell(long, "Default", "Default") == pytest.approx(0.997248, abs=1e-6)


def test_key_rates(P):
    r = transitions.key_rates(P).first()
    assert (r.low_retention, r.medium_recovery, r.high_to_default, r.default_persist) == \
        (0.9406, 0.1812, 0.2224, 0.9972)


@pytest.mark.parametrize("h,expected", [(3, 0.478619), (6, 0.646432), (12, 0.749402)])
def test_powers(P, h, expected):
    long = markov.matrix_power(P, [h])
    assert cell(long, "High", "Default") == pytest.approx(expected, abs=1e-6)


def test_six_month_high_row(P):
    long = markov.matrix_power(P, [6])
    got = [cell(long, "High", s) for s in STATES]
    assert got == pytest.approx([0.103337, 0.110729, 0.139502, 0.646432], abs=1e-6)


def test_time_to_absorption(P):
    t = {r.risk_state: r for r in markov.time_to_absorption(P).collect()}
    assert t["Low"].expected_months_to_default == 60.96
    assert t["Medium"].expected_months_to_default == 47.93
    assert t["High"].expected_months_to_default == 17.53
    assert t["Low"].expected_years_to_default == 5.08
    assert all(t[s].absorption_probability == pytest.approx(1.0, abs=1e-6) for s in t)


def test_absorption_summary_and_checks(P):
    s = {r.state: r for r in markov.absorption_summary(P).collect()}
    assert s["High"].months == 17.5 and s["Low"].years == 5.1
    assert s["High"].default_self_transition == 0.9972
    chk = markov.matrix_checks(P).first()
    assert chk.rows_sum_to_one and chk.default_absorbing and chk.non_negative and chk.q_plus_r_is_one


def test_classify_and_reach(P):
    c = {r.state: r.absorbing for r in markov.classify_states(P).collect()}
    assert c == {"Low": False, "Medium": False, "High": False, "Default": True}
    r = markov.reachability(P).collect()
    assert all(x.all_transient_reach for x in r)


def test_portfolio_forecast(spark, P):
    # a snapshot whose state shares are the published current distribution
    shares = [633043, 54678, 29225, 283054]
    cum = [sum(shares[:i + 1]) for i in range(4)]
    snap = spark.range(1000000).select(
        F.lit("2026-01").alias("observation_month"), F.lit("X").alias("segment"),
        F.when(F.col("id") < cum[0], "Low").when(F.col("id") < cum[1], "Medium")
         .when(F.col("id") < cum[2], "High").otherwise("Default").alias("risk_state"))
    t = {r.horizon_months: r for r in markov.portfolio_forecast_table(snap, P).collect()}
    assert t[0].Default == pytest.approx(0.283054, abs=1e-6)
    assert t[1].Default == pytest.approx(0.290656, abs=2e-6)
    assert t[3].Default == pytest.approx(0.305308, abs=2e-6)
    assert t[6].Default == pytest.approx(0.330354, abs=2e-6)
    assert t[6].Low == pytest.approx(0.523643, abs=2e-6)


def test_within_term_uses_power_cap(spark, P):
    acc = spark.createDataFrame([("a", "High", 61), ("b", "High", 6), ("c", "Other", 3)],
                                "loan_id string, risk_state string, remaining_months int")
    w = {r.loan_id: r.within_term_default_prob for r in markov.within_term_default_prob(acc, P).collect()}
    # remaining 61 is capped at 60; the published watchlist's top High probability
    assert w["a"] == pytest.approx(0.8429350630308394, abs=1e-9)
    assert w["c"] is None


def test_fundamental_matrix_general_inverse(P):
    n = markov.fundamental_matrix(P).collect()
    assert len(n) == 9
    rows = {}
    for r in n:
        rows.setdefault(r.from_state, 0.0)
        rows[r.from_state] += r.n_visits
    assert rows["High"] == pytest.approx(17.5329, abs=1e-3)
