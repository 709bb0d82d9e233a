"""Hand-made edge rows (FIXTURES section 2)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.columns import state_from_dpd, urgency_label
from riskflow.operators import (account, clean, evaluate, features, overview, transitions,
                                validate, watchlist)
from riskflow.schema import PANEL_SCHEMA


def panel(spark, rows):
    """rows: dicts with any panel columns; the rest are null. row_seq = list order."""
    names = [f.name for f in PANEL_SCHEMA.fields]
    data = [tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)]
    schema = T.StructType(PANEL_SCHEMA.fields + [T.StructField("row_seq", T.LongType())])
    return spark.createDataFrame(data, schema)


def row(loan, month, state, dpd, **kw):
    base = dict(loan_id=loan, customer_id="C" + loan, observation_month=month, risk_state=state,
                performance_class=state, days_in_arrears=float(dpd), segment="RETAIL",
                loan_term_months=12.0, instalments_in_arrears=0.0, disbursed_amount_lcy=100.0,
                principal_balance=50.0, disbursement_date="20240101", interest_rate=10.0)
    base.update(kw)
    return base


def test_state_from_dpd_bands(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 1.0, 30.0, 30.5, 31.0, 90.0, 91.0]], "d double")
    got = [r[0] for r in df.select(state_from_dpd("d")).collect()]
    assert got == ["Low", "Medium", "Medium", "Unknown", "High", "High", "Default"]


def test_next_state_is_next_row_across_gaps(spark):
    p = panel(spark, [row("A", "2024-01", "Low", 0), row("A", "2024-04", "High", 40),
                      row("B", "2024-01", "Medium", 5)])
    v = clean.verified_panel(p)
    got = {(r.loan_id, r.observation_month): r.next_risk_state for r in v.collect()}
    assert got[("A", "2024-01")] == "High"          # gap of two months collapses
    assert got[("A", "2024-04")] is None
    assert got[("B", "2024-01")] is None            # a loan with one month has no pair
    assert clean.transition_pairs(v).count() == 1


def test_duplicates_retained_and_counted(spark):
    p = panel(spark, [row("A", "2024-01", "Low", 0), row("A", "2024-01", "Medium", 3),
                      row("A", "2024-02", "High", 40)])
    v = clean.verified_panel(p)
    assert v.count() == 3
    pairs = [(r.risk_state, r.next_risk_state) for r in clean.transition_pairs(v).orderBy("row_seq").collect()]
    assert pairs == [("Low", "Medium"), ("Medium", "High")]   # same-month transition from the duplicate
    rep = {r.rule: r.violations for r in validate.rule_report(p).collect()}
    assert rep["V6_duplicate_rows"] == 1


def test_feature_nulls_and_clips(spark):
    p = panel(spark, [
        row("A", "2024-03", "Low", 0, principal_balance=None),                        # null balance
        row("B", "2024-03", "Low", 0, loan_term_months=None, instalments_in_arrears=2.0),
        row("C", "2024-03", "Low", 0, loan_term_months=0.0, instalments_in_arrears=2.0),
        row("D", "2024-03", "Low", 0, disbursement_date="2024131x"),                  # malformed
        row("E", "2024-03", "Low", 0, disbursement_date=None),
        row("F", "2024-03", "Low", 0, disbursement_date="20240515.0"),                # after obs month
        row("G", "2024-03", "Low", 0, principal_balance=-10.0),                       # clip to 1
    ])
    v = {r.loan_id: r for r in clean.verified_panel(p).collect()}
    assert v["A"].repayment_ratio is None
    assert v["B"].arrears_ratio == 0.0 and v["C"].arrears_ratio == 0.0
    assert v["D"].loan_age_months is None and v["E"].loan_age_months is None
    assert v["F"].loan_age_months == 0
    assert v["G"].repayment_ratio == 1.0
    assert v["A"].loan_age_months == 2


def test_trajectory_lags_and_streak(spark):
    p = panel(spark, [row("A", "2024-01", "Low", 0), row("A", "2024-02", "Medium", 10),
                      row("A", "2024-03", "Medium", 20), row("A", "2024-05", "High", 45)])
    f = {r.observation_month: r for r in features.trajectory_features(clean.verified_panel(p)).collect()}
    assert f["2024-01"].prev_dpd == 0.0 and f["2024-01"].prev_risk_state_code == 0
    assert f["2024-03"].months_in_state == 2 and f["2024-05"].months_in_state == 1
    assert f["2024-05"].prev_dpd_3m == 0.0 and f["2024-05"].dpd_velocity_3m == 45.0
    assert f["2024-03"].dpd_delta == 10.0 and f["2024-03"].projected_dpd_next == 30.0
    assert f["2024-03"].proj_will_be_medium == 1 and f["2024-05"].transitioning_up == 1


def test_empty_matrix_row_null_or_zero(spark):
    pairs = spark.createDataFrame([("Low", "Low"), ("Low", "High")], "risk_state string, next_risk_state string")
    null_rows = transitions.transition_matrix(pairs).filter("from_state = 'Medium'").collect()
    assert all(r.p is None for r in null_rows)
    zero_rows = transitions.transition_matrix(pairs, empty_row="zero").filter("from_state = 'Medium'").collect()
    assert all(r.p == 0.0 for r in zero_rows) and len(zero_rows) == 4


def test_segment_and_stage_pair_thresholds(spark):
    rows = [("S50", "Low", "Low")] * 50 + [("S51", "Low", "Low")] * 51 + [("UNKNOWN", "Low", "Low")] * 60
    pairs = spark.createDataFrame(rows, "segment string, risk_state string, next_risk_state string")
    segs = {r.segment for r in transitions.segment_transition_matrices(pairs, packed=True).collect()}
    assert segs == {"S51"}
    st = [("Early Stage",)] * 99 + [("Mid Stage",)] * 100
    sp = spark.createDataFrame(st, "lifecycle_stage string").withColumn("risk_state", F.lit("Low")) \
        .withColumn("next_risk_state", F.lit("Low"))
    stages = {r.lifecycle_stage for r in transitions.lifecycle_transition_matrices(sp, packed=True).collect()}
    assert stages == {"Mid Stage"}


def test_lifecycle_null_ratio_is_late(spark):
    df = spark.createDataFrame([(None, 12.0), (1, 12.0), (6, 12.0), (12, 12.0)],
                               "loan_age_months int, loan_term_months double")
    got = [r.lifecycle_stage for r in features.with_lifecycle_stage(df).collect()]
    assert got == ["Late Stage", "Early Stage", "Mid Stage", "Late Stage"]


def test_urgency_bins_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.2, 0.20001, 0.5, 0.75, 0.76, 1.0]], "p double")
    got = [r[0] for r in df.select(urgency_label("p")).collect()]
    assert got == [None, "Low urgency", "Medium urgency", "Medium urgency", "High urgency", "CRITICAL",
                   "CRITICAL"]


def test_search_is_literal(spark):
    p = panel(spark, [row("LN(1]", "2024-01", "Low", 0), row("LN2", "2024-01", "Low", 0)])
    assert account.account_search(p, "(").count() == 1
    assert account.account_search(p, "]").count() == 1
    assert account.account_search(p, "ln").count() == 2
    assert account.account_search(p, ".*").count() == 0


def test_blank_month_and_unknown_filter_and_paging(spark):
    p = panel(spark, [row(f"L{i}", "2024-01", "Medium", 5) for i in range(30)])
    assert overview.snapshot(p, " ").count() == 0
    assert overview.portfolio_snapshot(p, "").filter("count > 0").count() == 0
    scored = p.select("loan_id", "customer_id", "segment", "risk_state", "days_in_arrears",
                      "instalments_in_arrears", "principal_balance",
                      F.lit("High").alias("pred"), F.lit(0.3).alias("p_default"), F.lit(0.2).alias("p_high"),
                      F.lit(0.5).alias("score"), F.lit(0.4).alias("p_pred"), F.lit(True).alias("is_worse"))
    assert watchlist.watch_filter(scored, "nope").count() == 30
    pg = watchlist.watchlist(scored, "all_deteriorating", page=2, page_size=25).collect()
    assert len(pg) == 5 and pg[0].total == 30 and pg[0].total_pages == 2
    assert watchlist.watchlist(scored, "all_deteriorating", page=9, page_size=25).count() == 0
    assert watchlist.watchlist(scored, "all_deteriorating", page=1, page_size=500).count() == 30


def test_safe_encode_unseen_and_null(spark):
    train = spark.createDataFrame([("RETAIL",), ("SME",)], "segment string")
    enc = evaluate.label_encoding(train, "segment")
    snap = spark.createDataFrame([("RETAIL",), ("SME",), ("NEW",), (None,)], "segment string")
    got = [r.segment_enc for r in evaluate.safe_encode(snap, "segment", enc).orderBy(
        F.col("segment").asc_nulls_last()).collect()]
    assert got == [0, 0, 1, 0]   # NEW -> 0, RETAIL -> 0, SME -> 1, null -> 0


def test_suspended_rule_variants(spark):
    p = panel(spark, [row("A", "2024-01", "High", 90, suspended_interest=5.0)])
    loose = {r.rule: r.violations for r in validate.rule_report(p).collect()}
    strict = {r.rule: r.violations for r in validate.rule_report(p, strict_suspended=True).collect()}
    assert loose["V5_suspended_only_in_default"] == 0 and strict["V5_suspended_only_in_default"] == 1


def test_term_null_rule_variants(spark):
    p = panel(spark, [row("A", "2024-01", "Low", 0, loan_term_months=None)])
    assert {r.rule: r.violations for r in validate.rule_report(p).collect()}["V9_term_out_of_range"] == 0
    got = {r.rule: r.violations for r in validate.rule_report(p, term_nulls_violate=True).collect()}
    assert got["V9_term_out_of_range"] == 1


@pytest.mark.parametrize("month,expected", [("2024-02", 2), ("2024-01", 1)])
def test_prev_month_join_first_month(spark, month, expected):
    from riskflow.operators import scoring
    p = panel(spark, [row("A", "2024-01", "Low", 0), row("A", "2024-02", "High", 40),
                      row("B", "2024-02", "Medium", 3)])
    snap = overview.snapshot(p, month)
    j = {r.loan_id: r for r in scoring.prev_month_join(snap, p, month).collect()}
    assert len(j) == expected
    if month == "2024-01":
        assert j["A"].prev_dpd == 0.0 and j["A"].dpd_delta == 0.0    # first month: own DPD
    else:
        assert j["A"].prev_dpd == 0.0 and j["A"].prev_risk_state_code == 0
        assert j["B"].prev_dpd == 0.0 and j["B"].prev_risk_state_code == 1   # absent last month


def test_encode_state_and_dpd_state(spark):
    df = spark.createDataFrame([("Low", 0.0), ("Default", 95.0), ("Other", 30.5), (None, None)],
                               "risk_state string, days_in_arrears double")
    out = clean.with_state_from_dpd(clean.encode_state(df)).collect()
    assert [r.risk_state_code for r in out] == [0, 3, None, None]
    assert [r.dpd_state for r in out] == ["Low", "Default", "Unknown", "Unknown"]


def test_a_sticky_state_stays_transient(spark):
    """Low rarely moves (0.96): named absorbing states keep it transient."""
    from riskflow.operators import markov
    p = [[0.96, 0.03, 0.01, 0.0], [0.30, 0.40, 0.20, 0.10], [0.10, 0.10, 0.50, 0.30], [0.0, 0.0, 0.0, 1.0]]
    packed = spark.createDataFrame([(p,)], "P array<array<double>>")
    got = {r.state: r for r in markov.absorption_summary(packed).collect()}
    import numpy as np
    n = np.linalg.inv(np.eye(3) - np.array(p)[:3, :3])
    for k, s in enumerate(["Low", "Medium", "High"]):
        assert got[s].months == round(n.sum(axis=1)[k], 1) and got[s].probability == 1.0
        assert abs(got[s].visits_high - n[k, 2]) < 1e-4
    by_threshold = markov.time_to_absorption(packed)
    assert {r.risk_state for r in by_threshold.collect()} == {"Medium", "High"}
    named = markov.time_to_absorption(packed, absorbing=["Default"])
    assert {r.risk_state for r in named.collect()} == {"Low", "Medium", "High"}


def test_page_info_past_the_end(spark):
    from riskflow.operators import watchlist
    df = spark.createDataFrame([(f"L{i}", float(i)) for i in range(7)], "loan_id string, score double")
    assert watchlist.paginate(df, 9, 3).count() == 0
    assert tuple(watchlist.page_info(df, 9, 3).first()) == (7, 3, 9, 3)
    assert tuple(watchlist.page_info(df.where("false"), 1, 3).first()) == (0, 1, 1, 3)
