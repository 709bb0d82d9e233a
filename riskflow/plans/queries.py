"""The registered query set: one Spark plan per operator of the survey's
inventory, each paired with an equivalent DuckDB statement (or ``None``
where only a rows/invariants check is possible).

Every query reads the given tables (lineitem, part) through the panel
adapter, over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.columns import state_from_dpd
from riskflow.operators import (account, clean, evaluate, features, markov, overview, profile,
                                transitions, validate)
from riskflow.plans import oracle as O
from riskflow.plans.pipeline import SEARCH_TEXT, SNAPSHOT_MONTH, SNAPSHOT_SEGMENT, Portfolio
from riskflow.schema import PANEL_NAMES, ROW_SEQ
from riskflow.session import limit_methods, limit_partitions, write_stage
from riskflow.states import FIVE_STATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_PORTFOLIOS: dict[tuple[int, str], Portfolio] = {}


def pf(spark: SparkSession, sf_dir: str) -> Portfolio:
    key = (id(spark), sf_dir)
    if key not in _PORTFOLIOS:
        limit_methods(spark)
        limit_partitions(spark)
        _PORTFOLIOS[key] = Portfolio(spark, sf_dir)
    return _PORTFOLIOS[key]


_STAGES: dict[tuple, object] = {}


def _once(spark, d, name, make):
    """Stages and models are made once per application and data directory."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGES:
        _STAGES[key] = make()
    return _STAGES[key]


def _written(spark, d):
    """The featured panel, written once: fits and scores scan it."""
    return _once(spark, d, "panel", pf(spark, d).written_features)


def _staged(spark, d) -> Portfolio:
    """The portfolio over the written featured panel, for queries that read the
    panel more than once (matrix, snapshot, months): the adapter and the pass over
    neighbouring rows run once."""
    def make():
        p, table = Portfolio(spark, d), _written(spark, d)
        p.__dict__.update(rows=table, featured=table, verified=table.select(*pf(spark, d).verified.columns))
        return p
    return _once(spark, d, "portfolio", make)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


B = O.with_base

# ---------------------------------------------------------------------------
# Transitions
# ---------------------------------------------------------------------------


@register("transition_counts", B("", "SELECT from_state, to_state, from_idx, to_idx, n_pairs FROM cnt"))
def q_transition_counts(spark, d):
    return transitions.transition_counts(pf(spark, d).pairs)


@register("transition_matrix",
          B("", "SELECT from_state, to_state, from_idx, to_idx, n_pairs, p FROM pm"))
def q_transition_matrix(spark, d):
    return transitions.to_long(pf(spark, d).P)


def _rate_sql(a, b):
    return f"round(max(p) FILTER (WHERE from_state = '{a}' AND to_state = '{b}'), 4)"


@register("key_rates", B("", f"""
SELECT {_rate_sql('Low', 'Low')} AS low_retention, {_rate_sql('Medium', 'Low')} AS medium_recovery,
       {_rate_sql('High', 'Default')} AS high_to_default,
       {_rate_sql('Default', 'Default')} AS default_persist FROM pm"""))
def q_key_rates(spark, d):
    return transitions.key_rates(pf(spark, d).P)


def _group_matrix_ctes(src: str, key: str, having: str) -> str:
    return f"""
g_tot AS (SELECT {key}, count(*) AS n_total FROM {src} GROUP BY 1 HAVING {having}),
g_c AS (SELECT {key}, risk_state, next_risk_state, count(*) AS n FROM {src} GROUP BY ALL),
g_cnt AS (
  SELECT t.{key}, t.n_total, g.from_state, g.to_state, g.from_idx, g.to_idx,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_pairs
  FROM g_tot t CROSS JOIN grid g
  LEFT JOIN g_c c ON c.{key} = t.{key} AND c.risk_state = g.from_state
                 AND c.next_risk_state = g.to_state),
g_pm AS (
  SELECT *, CASE WHEN sum(n_pairs) OVER (PARTITION BY {key}, from_state) = 0 THEN 0.0
                 ELSE n_pairs / CAST(sum(n_pairs) OVER (PARTITION BY {key}, from_state) AS DOUBLE)
            END AS p
  FROM g_cnt)"""


SEG_CTES = _group_matrix_ctes("(SELECT * FROM pairs WHERE segment <> 'UNKNOWN')", "segment",
                              "count(*) >= 51")

STAGE_SRC = """(SELECT *, CASE WHEN r < 0.33 THEN 'Early Stage' WHEN r < 0.66 THEN 'Mid Stage'
                        ELSE 'Late Stage' END AS lifecycle_stage
               FROM (SELECT *, CASE WHEN loan_term_months > 0 THEN
                        CASE WHEN loan_age_months / loan_term_months < 0 THEN 0.0
                             WHEN loan_age_months / loan_term_months > 1 THEN 1.0
                             ELSE loan_age_months / loan_term_months END
                        ELSE 0.0 END AS r FROM pairs) x)"""
STAGE_CTES = _group_matrix_ctes(STAGE_SRC, "lifecycle_stage", "count(*) >= 100")


@register("segment_transition_matrices", B(SEG_CTES, """
SELECT segment, from_state, to_state, from_idx, to_idx, n_pairs, p FROM g_pm"""))
def q_segment_matrices(spark, d):
    return transitions.segment_transition_matrices(pf(spark, d).pairs)


def _group_rates_sql(key):
    return f"""
SELECT {key}, max(n_total) AS n_total, {_rate_sql('Default', 'Default')} AS default_persist,
       {_rate_sql('High', 'Default')} AS high_to_default,
       {_rate_sql('Medium', 'Low')} AS medium_recovery
FROM g_pm GROUP BY 1"""


@register("segment_key_rates", B(SEG_CTES, _group_rates_sql("segment")))
def q_segment_key_rates(spark, d):
    pk = transitions.segment_transition_matrices(pf(spark, d).pairs, packed=True)
    return transitions.group_key_rates(pk, ["segment"])


@register("lifecycle_transition_matrices", B(STAGE_CTES, """
SELECT lifecycle_stage, from_state, to_state, from_idx, to_idx, n_pairs, p FROM g_pm"""))
def q_stage_matrices(spark, d):
    return transitions.lifecycle_transition_matrices(pf(spark, d).pairs)


@register("lifecycle_key_rates", B(STAGE_CTES, _group_rates_sql("lifecycle_stage")))
def q_stage_key_rates(spark, d):
    pk = transitions.lifecycle_transition_matrices(pf(spark, d).pairs, packed=True)
    return transitions.group_key_rates(pk, ["lifecycle_stage"])


@register("lifecycle_effect", B(STAGE_CTES + """,
hd AS (SELECT lifecycle_stage, max(p) FILTER (WHERE from_state = 'High' AND to_state = 'Default') AS v
       FROM g_pm GROUP BY 1),
agg AS (SELECT count(*) AS n_stages, max(v) AS mx, min(v) AS mn FROM hd)""", """
SELECT n_stages, round(mx, 6) AS max_high_to_default, round(mn, 6) AS min_high_to_default,
       round(mx - mn, 6) AS spread, (mx - mn) > 0.05 AS significant
FROM agg WHERE n_stages >= 2"""))
def q_lifecycle_effect(spark, d):
    pk = transitions.lifecycle_transition_matrices(pf(spark, d).pairs, packed=True)
    return transitions.lifecycle_effect(pk)


FIVE_SQL_LABEL = """CASE WHEN days_in_arrears = 0 THEN 'Low'
  WHEN days_in_arrears >= 1 AND days_in_arrears <= 30 THEN 'Medium'
  WHEN days_in_arrears >= 31 AND days_in_arrears <= 60 THEN 'High-SubStd'
  WHEN days_in_arrears >= 61 AND days_in_arrears <= 90 THEN 'High-Doubtful'
  WHEN days_in_arrears > 90 THEN 'Default' END"""
FIVE_VALUES = ", ".join(f"('{s}', {i})" for i, s in enumerate(FIVE_STATES))


@register("five_state_matrix", B(f"""
f5 AS (SELECT loan_id, {FIVE_SQL_LABEL} AS s5,
              lead({FIVE_SQL_LABEL}) OVER (PARTITION BY loan_id ORDER BY observation_month, row_seq) AS n5
       FROM verified_out),
st5 AS (SELECT * FROM (VALUES {FIVE_VALUES}) AS t(state, idx)),
g5 AS (SELECT a.state AS from_state, a.idx AS from_idx, b.state AS to_state, b.idx AS to_idx
       FROM st5 a, st5 b),
c5 AS (SELECT s5, n5, count(*) AS n FROM f5 WHERE n5 IS NOT NULL GROUP BY 1, 2),
k5 AS (SELECT g.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_pairs FROM g5 g
       LEFT JOIN c5 c ON c.s5 = g.from_state AND c.n5 = g.to_state)""", """
SELECT from_state, to_state, from_idx, to_idx, n_pairs,
       round(CASE WHEN sum(n_pairs) OVER (PARTITION BY from_state) = 0 THEN 0.0
            ELSE n_pairs / CAST(sum(n_pairs) OVER (PARTITION BY from_state) AS DOUBLE) END, 4) AS p
FROM k5"""))
def q_five_state(spark, d):
    n = pf(spark, d).neighbours({"s": transitions.five_state_label()}, lead=True)
    pairs5 = n.select(transitions.five_state_label().alias("s5"), F.col("_next.s").alias("n5")) \
        .filter(F.col("n5").isNotNull())
    pk = transitions.transition_matrix_packed(pairs5, None, FIVE_STATES, "s5", "n5", empty_row="zero")
    return transitions.to_long(pk, None, FIVE_STATES).withColumn("p", F.round("p", 4))


# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------

@register("panel_shape", B("", """
SELECT count(*) AS n_rows, count(DISTINCT observation_month) AS n_months,
       count(DISTINCT loan_id) AS n_loans, count(DISTINCT customer_id) AS n_customers FROM panel"""))
def q_panel_shape(spark, d):
    return profile.panel_shape(pf(spark, d).panel)


_NULLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM panel"
    for c in PANEL_NAMES)


@register("null_counts", B("", f"SELECT * FROM ({_NULLS_SQL}) x WHERE n_null > 0"))
def q_null_counts(spark, d):
    return profile.null_counts(pf(spark, d).panel, PANEL_NAMES)


@register("total_nulls_after_cleaning", B("", "SELECT CAST(" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in PANEL_NAMES) +
    " AS BIGINT) AS total_nulls FROM cleaned"))
def q_total_nulls(spark, d):
    return profile.total_nulls(clean.clean_panel(pf(spark, d).panel), PANEL_NAMES)


@register("value_distribution", B("", """
SELECT risk_state, count(*) AS count,
       round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM verified_out GROUP BY 1"""))
def q_value_distribution(spark, d):
    return profile.value_distribution(pf(spark, d).rows, "risk_state")


@register("describe_dpd", B("", """
SELECT CAST(count(days_in_arrears) AS DOUBLE) AS count, round(avg(days_in_arrears), 1) AS mean,
       round(stddev_samp(days_in_arrears), 1) AS std, round(min(days_in_arrears), 1) AS min,
       round(quantile_cont(days_in_arrears, 0.25), 1) AS p25,
       round(quantile_cont(days_in_arrears, 0.5), 1) AS p50,
       round(quantile_cont(days_in_arrears, 0.75), 1) AS p75,
       round(max(days_in_arrears), 1) AS max FROM verified_out"""))
def q_describe_dpd(spark, d):
    return profile.describe(pf(spark, d).rows, "days_in_arrears")


LATEST_REM_CTES = """
latest AS (SELECT * FROM verified_out WHERE observation_month = (SELECT max(observation_month) FROM verified_out)),
latest_rem AS (
  SELECT *, CAST(coalesce(CASE WHEN loan_term_months - loan_age_months < 1 THEN 1.0
                               ELSE loan_term_months - loan_age_months END, 12.0) AS INTEGER) AS remaining_months
  FROM latest)"""


@register("remaining_buckets", B(LATEST_REM_CTES, """
SELECT count(*) FILTER (WHERE remaining_months <= 3) AS le_3,
       count(*) FILTER (WHERE remaining_months <= 6) AS le_6,
       count(*) FILTER (WHERE remaining_months > 24) AS gt_24 FROM latest_rem"""))
def q_remaining_buckets(spark, d):
    return profile.remaining_buckets(pf(spark, d).latest_with_remaining)


@register("describe_remaining_months", B(LATEST_REM_CTES, """
SELECT CAST(count(remaining_months) AS DOUBLE) AS count, round(avg(remaining_months), 1) AS mean,
       round(stddev_samp(remaining_months), 1) AS std, round(min(remaining_months), 1) AS min,
       round(quantile_cont(remaining_months, 0.25), 1) AS p25,
       round(quantile_cont(remaining_months, 0.5), 1) AS p50,
       round(quantile_cont(remaining_months, 0.75), 1) AS p75,
       round(max(remaining_months), 1) AS max FROM latest_rem"""))
def q_describe_remaining(spark, d):
    return profile.describe(pf(spark, d).latest_with_remaining, "remaining_months")


@register("segment_coverage", B("", """
SELECT segment, count(*) AS n_loans FROM (
  SELECT loan_id, arg_min(segment, (row_seq, observation_month)) AS segment FROM panel GROUP BY 1) x
WHERE segment IS NOT NULL GROUP BY 1"""))
def q_segment_coverage(spark, d):
    return profile.segment_coverage(pf(spark, d).panel)


@register("class_balance", B("", "SELECT next_risk_state, count(*) AS n FROM pairs GROUP BY 1"))
def q_class_balance(spark, d):
    return profile.class_balance(pf(spark, d).pairs)


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------

def _rule_sql(strict: bool, term_nulls: bool) -> str:
    susp = "days_in_arrears <= 90" if strict else "days_in_arrears < 90"
    term = ("NOT coalesce(loan_term_months BETWEEN 1 AND 360, false)" if term_nulls
            else "NOT (loan_term_months BETWEEN 1 AND 360)")
    rules = [
        ("V1_dpd0_is_low", "days_in_arrears = 0 AND risk_state <> 'Low'"),
        ("V2_dpd1_30_is_medium", "days_in_arrears >= 1 AND days_in_arrears <= 30 AND risk_state <> 'Medium'"),
        ("V3_dpd31_90_is_high", "days_in_arrears >= 31 AND days_in_arrears <= 90 AND risk_state <> 'High'"),
        ("V4_dpd_gt90_is_default", "days_in_arrears > 90 AND risk_state <> 'Default'"),
        ("V5_suspended_only_in_default", f"suspended_interest > 0 AND {susp}"),
        ("V7_negative_dpd", "days_in_arrears < 0"),
        ("V8_interest_rate_out_of_range", "interest_rate < 0 OR interest_rate > 50"),
        ("V8b_interest_rate_scale", "interest_rate > 50"),
        ("V9_term_out_of_range", term),
        ("V11_critical_nulls", "customer_id IS NULL OR loan_id IS NULL OR observation_month IS NULL "
                               "OR days_in_arrears IS NULL OR risk_state IS NULL OR performance_class IS NULL"),
    ]
    parts = [f"SELECT '{n}' AS rule, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS violations FROM panel"
             for n, p in rules]
    parts.append("SELECT 'V6_duplicate_rows' AS rule, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS violations "
                 "FROM (SELECT count(*) AS c FROM panel GROUP BY loan_id, observation_month) x")
    return B("", "SELECT rule, violations, CASE WHEN violations = 0 THEN 'PASS' "
                 "ELSE 'FLAG — ' || format('{:,}', violations) || ' records' END AS status FROM (" +
             " UNION ALL ".join(parts) + ") r")


@register("rule_report", _rule_sql(False, False))
def q_rule_report(spark, d):
    return validate.rule_report(pf(spark, d).panel)


@register("rule_report_strict", _rule_sql(True, True))
def q_rule_report_strict(spark, d):
    return validate.rule_report(pf(spark, d).panel, strict_suspended=True, term_nulls_violate=True)


@register("rule_verdict", _rule_sql(False, False).replace(
    "SELECT rule, violations, CASE", "SELECT count(*) FILTER (WHERE violations > 0) AS n_flagged, "
    "CASE WHEN count(*) FILTER (WHERE violations > 0) = 0 THEN 'PASSED' ELSE 'FLAGS' END AS verdict "
    "FROM (SELECT rule, violations, CASE", 1) + ") v")
def q_rule_verdict(spark, d):
    return validate.overall_verdict(validate.rule_report(pf(spark, d).panel))


@register("panel_continuity", B("", """
SELECT max(a) AS n_months, count(*) FILTER (WHERE m = a) AS complete_loans,
       count(*) FILTER (WHERE m < a) AS incomplete_loans
FROM (SELECT loan_id, count(DISTINCT observation_month) AS m FROM panel GROUP BY 1) x,
     (SELECT count(DISTINCT observation_month) AS a FROM panel) y"""))
def q_panel_continuity(spark, d):
    return validate.panel_continuity(pf(spark, d).panel)


@register("duplicate_lineitem_keys", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) x""")
def q_duplicate_lineitem(spark, d):
    return validate.duplicate_rows(pf(spark, d).lineitem(), ("l_orderkey", "l_linenumber"))


@register("matrix_checks", B("", """
SELECT bool_and(abs(rs - 1.0) <= 0.001) AS rows_sum_to_one,
       (SELECT max(p) FROM pm WHERE from_idx = 3 AND to_idx = 3) >= 0.95 AS default_absorbing,
       (SELECT bool_and(p >= 0) FROM pm) AS non_negative,
       bool_and(abs(rs - 1.0) <= 0.001) FILTER (WHERE from_idx < 3) AS q_plus_r_is_one
FROM (SELECT from_idx, sum(p) AS rs FROM pm GROUP BY 1) x"""))
def q_matrix_checks(spark, d):
    return markov.matrix_checks(pf(spark, d).P)


# ---------------------------------------------------------------------------
# Cleaning and features
# ---------------------------------------------------------------------------

@register("removed_count", B("", """
SELECT count(*) AS before,
       count(*) FILTER (WHERE NOT (customer_id IS NULL OR loan_id IS NULL OR observation_month IS NULL
             OR days_in_arrears IS NULL OR risk_state IS NULL OR performance_class IS NULL)) AS after,
       count(*) FILTER (WHERE customer_id IS NULL OR loan_id IS NULL OR observation_month IS NULL
             OR days_in_arrears IS NULL OR risk_state IS NULL OR performance_class IS NULL) AS removed
FROM panel"""))
def q_removed_count(spark, d):
    return clean.removed_count(pf(spark, d).panel)


@register("clean_panel", B("", "SELECT * FROM cleaned"))
def q_clean_panel(spark, d):
    return clean.clean_panel(pf(spark, d).panel)


@register("verified_panel", B("", "SELECT * FROM verified_out"))
def q_verified_panel(spark, d):
    return pf(spark, d).verified


@register("state_from_dpd", B("", """
SELECT CASE WHEN days_in_arrears = 0 THEN 'Low' WHEN days_in_arrears >= 1 AND days_in_arrears <= 30 THEN 'Medium'
            WHEN days_in_arrears >= 31 AND days_in_arrears <= 90 THEN 'High'
            WHEN days_in_arrears > 90 THEN 'Default' ELSE 'Unknown' END AS dpd_state,
       count(*) AS n
FROM (SELECT days_in_arrears FROM verified_out
      UNION ALL SELECT days_in_arrears + 0.5 FROM verified_out WHERE days_in_arrears = 30) x GROUP BY 1"""))
def q_state_from_dpd(spark, d):
    v = pf(spark, d).rows.select("days_in_arrears")
    half = v.filter(F.col("days_in_arrears") == 30).select((F.col("days_in_arrears") + 0.5)
                                                           .alias("days_in_arrears"))
    return v.unionByName(half).groupBy(state_from_dpd("days_in_arrears").alias("dpd_state")) \
        .agg(F.count(F.lit(1)).alias("n"))


TRAJ_SQL = """
traj0 AS (
  SELECT *, CAST(coalesce(lag(risk_state_code, 1) OVER w, risk_state_code) AS INTEGER) AS prev_risk_state_code,
         coalesce(lag(days_in_arrears, 1) OVER w, 0.0) AS prev_dpd,
         coalesce(lag(days_in_arrears, 2) OVER w, 0.0) AS prev_dpd_2m,
         coalesce(lag(days_in_arrears, 3) OVER w, 0.0) AS prev_dpd_3m,
         row_number() OVER w AS rn,
         (lag(risk_state, 1) OVER w IS NULL OR lag(risk_state, 1) OVER w <> risk_state) AS chg
  FROM verified_out WINDOW w AS (PARTITION BY loan_id ORDER BY observation_month, row_seq)),
traj1 AS (
  SELECT * EXCLUDE (rn, chg),
         CAST(rn - max(CASE WHEN chg THEN rn END) OVER (PARTITION BY loan_id ORDER BY observation_month, row_seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS INTEGER) AS months_in_state,
         coalesce(days_in_arrears - prev_dpd, 0.0) AS dpd_delta,
         coalesce(days_in_arrears - prev_dpd_2m, 0.0) AS dpd_velocity_2m,
         coalesce(days_in_arrears - prev_dpd_3m, 0.0) AS dpd_velocity_3m
  FROM traj0),
traj2 AS (
  SELECT *,
    CASE WHEN raw_bp < 0 THEN 0.0 WHEN raw_bp > 1 THEN 1.0 ELSE raw_bp END AS dpd_band_position,
    CASE WHEN days_in_arrears + dpd_delta < 0 THEN 0.0 ELSE days_in_arrears + dpd_delta END AS projected_dpd_next,
    dpd_delta * 0.6 + dpd_velocity_2m / 2.0 * 0.4 AS smooth_velocity
  FROM (SELECT *, CASE WHEN risk_state = 'Low' THEN days_in_arrears / 3.0
          WHEN risk_state = 'Medium' THEN (CASE WHEN days_in_arrears - 5 < 0 THEN 0.0 ELSE days_in_arrears - 5 END) / 24.0
          WHEN risk_state = 'High' THEN (CASE WHEN days_in_arrears - 31 < 0 THEN 0.0 ELSE days_in_arrears - 31 END) / 58.0
          WHEN risk_state = 'Default' THEN (CASE WHEN days_in_arrears / 280.0 > 1 THEN 1.0 ELSE days_in_arrears / 280.0 END)
          ELSE 0.0 END AS raw_bp FROM traj1) x),
traj AS (
  SELECT * EXCLUDE (raw_bp, sp),
    sp AS smooth_proj_dpd,
    CAST(projected_dpd_next >= 31 AND projected_dpd_next <= 90 AS INTEGER) AS proj_will_be_high,
    CAST(projected_dpd_next > 90 AS INTEGER) AS proj_will_be_default,
    CAST(projected_dpd_next >= 1 AND projected_dpd_next <= 30 AS INTEGER) AS proj_will_be_medium,
    CAST(projected_dpd_next = 0 AS INTEGER) AS proj_will_be_low,
    CAST(sp >= 31 AND sp <= 90 AS INTEGER) AS smooth_proj_high,
    CAST(sp > 90 AS INTEGER) AS smooth_proj_default,
    CAST(risk_state_code > prev_risk_state_code AS INTEGER) AS transitioning_up,
    CAST(risk_state_code < prev_risk_state_code AS INTEGER) AS transitioning_down,
    CAST(days_in_arrears >= 22 AND days_in_arrears <= 30 AS INTEGER) AS near_high_threshold,
    CAST(days_in_arrears >= 75 AND days_in_arrears <= 90 AS INTEGER) AS near_default_threshold,
    CAST(days_in_arrears >= 1 AND days_in_arrears <= 8 AS INTEGER) AS near_medium_threshold
  FROM (SELECT *, CASE WHEN days_in_arrears + smooth_velocity < 0 THEN 0.0
                       ELSE days_in_arrears + smooth_velocity END AS sp FROM traj2) y)"""


@register("trajectory_features", B(TRAJ_SQL, "SELECT * FROM traj"))
def q_trajectory(spark, d):
    return pf(spark, d).featured


@register("month_index", B("", """
SELECT observation_month, CAST(dense_rank() OVER (ORDER BY observation_month) AS INTEGER) AS month_idx,
       lag(observation_month) OVER (ORDER BY observation_month) AS prev_month
FROM (SELECT DISTINCT observation_month FROM panel) m"""))
def q_month_index(spark, d):
    return features.month_index(pf(spark, d).panel)


@register("lifecycle_stage_counts", B("", f"""
SELECT lifecycle_stage, count(*) AS n FROM {STAGE_SRC} s GROUP BY 1"""))
def q_stage_counts(spark, d):
    s = features.with_lifecycle_stage(pf(spark, d).pairs)
    return s.groupBy("lifecycle_stage").agg(F.count(F.lit(1)).alias("n"))


@register("remaining_months", B(LATEST_REM_CTES, """
SELECT loan_id, observation_month, loan_term_months, loan_age_months, remaining_months FROM latest_rem"""))
def q_remaining_months(spark, d):
    return pf(spark, d).latest_with_remaining.select(
        "loan_id", "observation_month", "loan_term_months", "loan_age_months", "remaining_months")


@register("payment_flags", B("", """
SELECT loan_id, observation_month,
  CASE WHEN coalesce(days_in_arrears, 0) > 90 THEN 'Default' WHEN coalesce(days_in_arrears, 0) > 30 THEN 'High'
       WHEN coalesce(days_in_arrears, 0) > 0 THEN 'Medium' ELSE 'Low' END AS dpd_flag,
  CASE WHEN coalesce(instalments_in_arrears, 0) > 2 THEN 'High'
       WHEN coalesce(instalments_in_arrears, 0) > 0 THEN 'Medium' ELSE 'Low' END AS instalment_flag,
  CASE WHEN coalesce(repayment_ratio, 0) > 0.8 THEN 'Low'
       WHEN coalesce(repayment_ratio, 0) > 0.5 THEN 'Medium' ELSE 'High' END AS repayment_flag,
  CASE WHEN coalesce(penal_interest, 0) > 0 THEN 'High' ELSE 'Low' END AS penal_flag,
  CASE WHEN coalesce(suspended_interest, 0) > 0 THEN 'Default' ELSE 'Low' END AS suspended_flag
FROM verified_out"""))
def q_payment_flags(spark, d):
    f = features.payment_flags(pf(spark, d).rows)
    return f.select("loan_id", "observation_month", "dpd_flag", "instalment_flag", "repayment_flag",
                    "penal_flag", "suspended_flag")


# ---------------------------------------------------------------------------
# Snapshots, overview and account lookup
# ---------------------------------------------------------------------------

@register("snapshot", B("", f"""
SELECT * FROM verified_out WHERE observation_month = '{SNAPSHOT_MONTH}' AND segment = '{SNAPSHOT_SEGMENT}'"""))
def q_snapshot(spark, d):
    return overview.snapshot(pf(spark, d).verified, SNAPSHOT_MONTH, SNAPSHOT_SEGMENT)


@register("latest_snapshot", B(LATEST_REM_CTES, "SELECT * FROM latest"))
def q_latest_snapshot(spark, d):
    return pf(spark, d).latest


@register("list_months", B("", "SELECT DISTINCT observation_month FROM verified_out"))
def q_list_months(spark, d):
    return overview.list_months(pf(spark, d).rows)


@register("list_segments", B("", """
SELECT segment FROM (SELECT 'All Segments' AS segment UNION ALL
  SELECT DISTINCT segment FROM verified_out WHERE segment IS NOT NULL AND segment <> 'UNKNOWN') x"""))
def q_list_segments(spark, d):
    return overview.list_segments(pf(spark, d).rows)


def _snapshot_sql(month, segment):
    seg = "" if segment in (None, "All Segments") else f" AND segment = '{segment}'"
    return B("", f"""
SELECT '{month}' AS month, s.state, coalesce(c.n, 0) AS count, t.total,
       CASE WHEN t.total > 0 THEN round(CAST(coalesce(c.n, 0) AS DOUBLE) * 100.0 / t.total, 1) ELSE 0.0 END AS pct
FROM st s
LEFT JOIN (SELECT risk_state, count(*) AS n FROM verified_out WHERE observation_month = '{month}'{seg} GROUP BY 1) c
  ON c.risk_state = s.state,
(SELECT count(*) AS total FROM verified_out WHERE observation_month = '{month}'{seg}) t""")


@register("portfolio_snapshot", _snapshot_sql(SNAPSHOT_MONTH, None))
def q_portfolio_snapshot(spark, d):
    return overview.portfolio_snapshot(pf(spark, d).rows, SNAPSHOT_MONTH)


@register("portfolio_snapshot_segment", _snapshot_sql(SNAPSHOT_MONTH, SNAPSHOT_SEGMENT))
def q_portfolio_snapshot_seg(spark, d):
    return overview.portfolio_snapshot(pf(spark, d).rows, SNAPSHOT_MONTH, SNAPSHOT_SEGMENT)


_TREND_COLS = ", ".join(f"count(*) FILTER (WHERE risk_state = '{s}') AS \"{s}\""
                        for s in ("Low", "Medium", "High", "Default"))


@register("risk_trend", B("", f"SELECT observation_month, {_TREND_COLS} FROM verified_out GROUP BY 1"))
def q_risk_trend(spark, d):
    return overview.risk_trend(pf(spark, d).rows)


@register("risk_trend_pct", B("", "SELECT observation_month, " + ", ".join(
    f"round(CAST(\"{s}\" AS DOUBLE) * 100.0 / (\"Low\" + \"Medium\" + \"High\" + \"Default\"), 4) AS \"{s}\""
    for s in ("Low", "Medium", "High", "Default")) +
    f" FROM (SELECT observation_month, {_TREND_COLS} FROM verified_out GROUP BY 1) t"))
def q_risk_trend_pct(spark, d):
    return overview.risk_trend_pct(pf(spark, d).rows)


@register("trend_tail", B("", f"""
SELECT *, "Low" + "Medium" + "High" + "Default" AS total
FROM (SELECT observation_month, {_TREND_COLS} FROM verified_out GROUP BY 1) t
ORDER BY observation_month DESC LIMIT 8"""))
def q_trend_tail(spark, d):
    return overview.trend_tail(pf(spark, d).rows)


SEARCH_SQL = (f"(SELECT * FROM verified_out WHERE contains(lower(loan_id), lower('{SEARCH_TEXT}')) "
              f"OR contains(lower(customer_id), lower('{SEARCH_TEXT}')))")


@register("account_search", B("", f"SELECT * FROM {SEARCH_SQL} s"))
def q_account_search(spark, d):
    return account.account_search(pf(spark, d).verified, SEARCH_TEXT)


@register("account_search_special", B("", """
SELECT * FROM verified_out WHERE contains(lower(loan_id), 'n_12') OR contains(lower(customer_id), 'n_12')"""))
def q_account_search_special(spark, d):
    return account.account_search(pf(spark, d).verified, "N_12")


@register("account_latest_rows", B("", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY loan_id
  ORDER BY observation_month DESC, row_seq DESC) AS rn FROM {SEARCH_SQL} s) x WHERE rn = 1"""))
def q_account_latest_rows(spark, d):
    return account.latest_rows(account.account_search(pf(spark, d).verified, SEARCH_TEXT))


_PROFILE_SQL = """loan_id, customer_id, segment, loan_type, observation_month AS last_month, risk_state,
  coalesce(days_in_arrears, 0.0) AS days_in_arrears, coalesce(instalments_in_arrears, 0.0) AS instalments_in_arrears,
  coalesce(repayment_ratio, 0.0) AS repayment_ratio, coalesce(penal_interest, 0.0) AS penal_interest,
  coalesce(suspended_interest, 0.0) AS suspended_interest, coalesce(principal_balance, 0.0) AS principal_balance,
  coalesce(disbursed_amount_lcy, 0.0) AS disbursed_amount, coalesce(interest_rate, 0.0) AS interest_rate,
  coalesce(loan_term_months, 0.0) AS loan_term_months"""


@register("account_profile", B("", f"""
SELECT {_PROFILE_SQL} FROM {SEARCH_SQL} s
ORDER BY observation_month DESC, row_seq DESC, loan_id DESC LIMIT 1"""))
def q_account_profile(spark, d):
    m = account.account_search(pf(spark, d).rows, SEARCH_TEXT)
    return account.account_profile(account.latest_match(m))


@register("account_history", B("", f"""
SELECT loan_id, observation_month, risk_state, coalesce(days_in_arrears, 0.0) AS days_in_arrears,
       coalesce(instalments_in_arrears, 0.0) AS instalments_in_arrears,
       coalesce(repayment_ratio, 0.0) AS repayment_ratio, coalesce(penal_interest, 0.0) AS penal_interest,
       coalesce(suspended_interest, 0.0) AS suspended_interest FROM {SEARCH_SQL} s"""))
def q_account_history(spark, d):
    return account.account_history(account.account_search(pf(spark, d).rows, SEARCH_TEXT))


# ---------------------------------------------------------------------------
# Markov algebra
# ---------------------------------------------------------------------------

SN = O.STATE_NAME


@register("matrix_power", B(O.power_cte(12), f"""
SELECT h AS horizon, {SN.format(c='i')} AS from_state, {SN.format(c='j')} AS to_state,
       i AS from_idx, j AS to_idx, round(p, 6) AS p FROM pw WHERE h IN (1, 3, 6, 12)
UNION ALL
SELECT 0, from_state, to_state, from_idx, to_idx, CASE WHEN from_idx = to_idx THEN 1.0 ELSE 0.0 END FROM grid"""))
def q_matrix_power(spark, d):
    return markov.matrix_power(pf(spark, d).P, [0, 1, 3, 6, 12], digits=6)


@register("forecast", B(O.power_cte(6), f"""
SELECT 6 AS horizon,
       (SELECT round(p, 4) FROM pw WHERE h = 6 AND i = 2 AND j = 3) AS high_to_default,
       {SN.format(c='i')} AS from_state, {SN.format(c='j')} AS to_state, i AS from_idx, j AS to_idx,
       round(p, 4) AS p FROM pw WHERE h = 6"""))
def q_forecast(spark, d):
    return markov.forecast(pf(spark, d).P, 6)


def _evolution_sql(month_expr: str, horizon: int, scale: str, digits: int, seg: str = "") -> str:
    return f"""
snapc AS (SELECT risk_state, count(*) AS n FROM verified_out
          WHERE observation_month = {month_expr}{seg} GROUP BY 1),
tot AS (SELECT sum(n) AS total FROM snapc),
pi0 AS (SELECT s.idx AS j, CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(t.total AS DOUBLE) AS v
        FROM st s LEFT JOIN snapc c ON c.risk_state = s.state, tot t WHERE t.total > 0),
ev(n, j, v) AS (
  SELECT 0, j, v FROM pi0
  UNION ALL
  SELECT ev.n + 1, pm.to_idx, sum(ev.v * pm.p) FROM ev JOIN pm ON ev.j = pm.from_idx
  WHERE ev.n < {horizon} GROUP BY ev.n + 1, pm.to_idx),
evo AS (SELECT n AS horizon_months, {SN.format(c='j')} AS state, round(v * {scale}, {digits}) AS pct FROM ev)"""


@register("portfolio_evolution", B(_evolution_sql(f"'{SNAPSHOT_MONTH}'", 6, "100.0", 2),
                                   "SELECT * FROM evo"))
def q_portfolio_evolution(spark, d):
    return markov.portfolio_evolution(pf(spark, d).rows, pf(spark, d).P, SNAPSHOT_MONTH, horizon=6)


@register("portfolio_evolution_segment", B(_evolution_sql(f"'{SNAPSHOT_MONTH}'", 12, "100.0", 2,
                                                          f" AND segment = '{SNAPSHOT_SEGMENT}'"),
                                           "SELECT * FROM evo"))
def q_portfolio_evolution_seg(spark, d):
    return markov.portfolio_evolution(pf(spark, d).rows, pf(spark, d).P, SNAPSHOT_MONTH,
                                      SNAPSHOT_SEGMENT, horizon=12)


@register("portfolio_forecast_table", B(_evolution_sql("(SELECT max(observation_month) FROM verified_out)",
                                                       6, "1.0", 6), """
SELECT horizon_months, max(pct) FILTER (WHERE state = 'Low') AS "Low",
       max(pct) FILTER (WHERE state = 'Medium') AS "Medium", max(pct) FILTER (WHERE state = 'High') AS "High",
       max(pct) FILTER (WHERE state = 'Default') AS "Default"
FROM evo WHERE horizon_months IN (0, 1, 3, 6) GROUP BY 1"""))
def q_portfolio_forecast_table(spark, d):
    return markov.portfolio_forecast_table(pf(spark, d).rows, pf(spark, d).P)


def _horizon_default_sql(hs):
    return B(O.power_cte(max(hs)), f"""
SELECT h AS horizon, {SN.format(c='i')} AS state, round(p, 6) AS p_default
FROM pw WHERE j = 3 AND h IN ({', '.join(map(str, hs))})""")


@register("horizon_default", _horizon_default_sql([1, 3, 6]))
def q_horizon_default(spark, d):
    return markov.horizon_default(pf(spark, d).P, (1, 3, 6))


@register("horizon_default_long", _horizon_default_sql([3, 6, 12, 24]))
def q_horizon_default_long(spark, d):
    return markov.horizon_default(pf(spark, d).P, (3, 6, 12, 24))


@register("default_curve", B(O.power_cte(60), f"""
SELECT h AS n, {SN.format(c='i')} AS state, round(p, 6) AS p_default FROM pw WHERE j = 3 AND i <> 3"""))
def q_default_curve(spark, d):
    return markov.default_curve(pf(spark, d).P, 60)


@register("power_table", B(O.power_cte(60), f"""
SELECT h AS n, {SN.format(c='i')} AS from_state, {SN.format(c='j')} AS to_state, i AS from_idx, j AS to_idx,
       round(p, 6) AS p FROM pw"""))
def q_power_table(spark, d):
    return markov.power_table(pf(spark, d).P, 60).withColumn("p", F.round("p", 6))


WITHIN_CTES = LATEST_REM_CTES + "," + O.power_cte(60) + """,
wt AS (
  SELECT l.*, round(pw.p, 6) AS within_term_default_prob
  FROM latest_rem l LEFT JOIN pw ON pw.j = 3 AND pw.h = least(l.remaining_months, 60)
       AND pw.i = l.risk_state_code),
wl AS (
  SELECT loan_id, customer_id, risk_state, segment, days_in_arrears, instalments_in_arrears,
         remaining_months, within_term_default_prob,
         CASE WHEN within_term_default_prob > 0 AND within_term_default_prob <= 0.2 THEN 'Low urgency'
              WHEN within_term_default_prob > 0.2 AND within_term_default_prob <= 0.5 THEN 'Medium urgency'
              WHEN within_term_default_prob > 0.5 AND within_term_default_prob <= 0.75 THEN 'High urgency'
              WHEN within_term_default_prob > 0.75 AND within_term_default_prob <= 1.01 THEN 'CRITICAL'
         END AS urgency
  FROM wt WHERE risk_state IN ('Medium', 'High'))"""


def _within(spark, d):
    p = _staged(spark, d)
    w = markov.within_term_default_prob(p.latest_with_remaining, p.P)
    return w.withColumn("within_term_default_prob", F.round("within_term_default_prob", 6))


@register("within_term_default_prob", B(WITHIN_CTES, """
SELECT loan_id, customer_id, risk_state, remaining_months, within_term_default_prob FROM wt"""))
def q_within_term(spark, d):
    return _within(spark, d).select("loan_id", "customer_id", "risk_state", "remaining_months",
                                    "within_term_default_prob")


@register("within_term_watchlist", B(WITHIN_CTES, "SELECT * FROM wl"))
def q_within_watchlist(spark, d):
    from riskflow.operators import watchlist
    return watchlist.risk_watch_subset(_within(spark, d))


@register("critical_accounts", B(WITHIN_CTES, """
SELECT loan_id, customer_id, risk_state, days_in_arrears, remaining_months, within_term_default_prob
FROM wt WHERE risk_state = 'High'
  AND ((SELECT count(*) FROM wt WHERE risk_state = 'High' AND remaining_months <= 6) = 0
       OR remaining_months <= 6)"""))
def q_critical_accounts(spark, d):
    from riskflow.operators import watchlist
    return watchlist.critical_accounts(_within(spark, d))


@register("critical_accounts_top10", B(WITHIN_CTES, """
SELECT loan_id, customer_id, risk_state, days_in_arrears, remaining_months, within_term_default_prob
FROM wt WHERE risk_state = 'High'
  AND ((SELECT count(*) FROM wt WHERE risk_state = 'High' AND remaining_months <= 6) = 0
       OR remaining_months <= 6)
ORDER BY within_term_default_prob DESC, loan_id LIMIT 10"""))
def q_critical_top10(spark, d):
    from riskflow.operators import watchlist
    c = watchlist.critical_accounts(_within(spark, d))
    return watchlist.top_n(c, 10, F.col("within_term_default_prob").desc(), F.col("loan_id"))


@register("watchlist_top15", B(WITHIN_CTES, """
SELECT * FROM wl ORDER BY within_term_default_prob DESC, loan_id LIMIT 15"""))
def q_watchlist_top15(spark, d):
    from riskflow.operators import watchlist
    w = watchlist.risk_watch_subset(_within(spark, d))
    return watchlist.top_n(w, 15, F.col("within_term_default_prob").desc(), F.col("loan_id"))


@register("prob_by_state", B(WITHIN_CTES, """
SELECT risk_state, round(avg(within_term_default_prob), 6) AS mean_prob,
       round(min(within_term_default_prob), 6) AS min_prob, round(max(within_term_default_prob), 6) AS max_prob
FROM wt GROUP BY 1"""))
def q_prob_by_state(spark, d):
    from riskflow.operators import watchlist
    return watchlist.prob_by_state(_within(spark, d))


@register("urgency_breakdown", B(WITHIN_CTES, "SELECT urgency, count(*) AS n FROM wl GROUP BY 1"))
def q_urgency_breakdown(spark, d):
    from riskflow.operators import watchlist
    return watchlist.urgency_breakdown(watchlist.risk_watch_subset(_within(spark, d)))


def absorb_ctes(src: str = "pm", by: str = "") -> str:
    """I - Q, its inverse by cofactors and the sums over it, per group; the
    absorbing state is Default."""
    g, per = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
qa AS (
  SELECT {g}max(CASE WHEN from_idx = 0 AND to_idx = 0 THEN 1.0 - p END) AS a00,
         max(CASE WHEN from_idx = 0 AND to_idx = 1 THEN -p END) AS a01,
         max(CASE WHEN from_idx = 0 AND to_idx = 2 THEN -p END) AS a02,
         max(CASE WHEN from_idx = 1 AND to_idx = 0 THEN -p END) AS a10,
         max(CASE WHEN from_idx = 1 AND to_idx = 1 THEN 1.0 - p END) AS a11,
         max(CASE WHEN from_idx = 1 AND to_idx = 2 THEN -p END) AS a12,
         max(CASE WHEN from_idx = 2 AND to_idx = 0 THEN -p END) AS a20,
         max(CASE WHEN from_idx = 2 AND to_idx = 1 THEN -p END) AS a21,
         max(CASE WHEN from_idx = 2 AND to_idx = 2 THEN 1.0 - p END) AS a22,
         max(CASE WHEN from_idx = 0 AND to_idx = 3 THEN p END) AS r0,
         max(CASE WHEN from_idx = 1 AND to_idx = 3 THEN p END) AS r1,
         max(CASE WHEN from_idx = 2 AND to_idx = 3 THEN p END) AS r2,
         max(CASE WHEN from_idx = 3 AND to_idx = 3 THEN p END) AS p33
  FROM {src}{per}),
qd AS (SELECT *, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20)
                 + a02 * (a10 * a21 - a11 * a20) AS det FROM qa),
ninv AS (
  SELECT * FROM (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)) AS c(i, j), qd),
nm AS (
  SELECT {g}i, j, CASE
      WHEN i = 0 AND j = 0 THEN (a11 * a22 - a12 * a21) WHEN i = 0 AND j = 1 THEN -(a01 * a22 - a02 * a21)
      WHEN i = 0 AND j = 2 THEN (a01 * a12 - a02 * a11) WHEN i = 1 AND j = 0 THEN -(a10 * a22 - a12 * a20)
      WHEN i = 1 AND j = 1 THEN (a00 * a22 - a02 * a20) WHEN i = 1 AND j = 2 THEN -(a00 * a12 - a02 * a10)
      WHEN i = 2 AND j = 0 THEN (a10 * a21 - a11 * a20) WHEN i = 2 AND j = 1 THEN -(a00 * a21 - a01 * a20)
      ELSE (a00 * a11 - a01 * a10) END / det AS v,
    CASE j WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS rj, p33
  FROM ninv),
tt AS (SELECT {g}i, sum(v * rj) AS b, sum(v) AS t, max(p33) AS p33,
              max(CASE WHEN j = 0 THEN v END) AS v0, max(CASE WHEN j = 1 THEN v END) AS v1,
              max(CASE WHEN j = 2 THEN v END) AS v2 FROM nm GROUP BY {g}i)"""


ABSORB_CTES = absorb_ctes()


@register("classify_states", B("", """
SELECT from_state AS state, round(p, 6) AS self_transition, p >= 0.95 AS absorbing
FROM pm WHERE from_idx = to_idx"""))
def q_classify_states(spark, d):
    return markov.classify_states(pf(spark, d).P)


@register("reachability", B(O.power_cte(100), f"""
SELECT {SN.format(c='i')} AS state, round(p, 6) AS p_reach_default, p > 0.001 AS can_reach,
       i IN (SELECT from_idx FROM pm WHERE from_idx = to_idx AND p < 0.95) AS transient,
       (SELECT coalesce(bool_and(x.p > 0.001), true) FROM pw x WHERE x.h = 100 AND x.j = 3
          AND x.i IN (SELECT from_idx FROM pm WHERE from_idx = to_idx AND p < 0.95)) AS all_transient_reach
FROM pw WHERE h = 100 AND j = 3"""))
def q_reachability(spark, d):
    return markov.reachability(pf(spark, d).P)


@register("canonical_form", B("", """
SELECT from_state, to_state, p, CASE WHEN to_idx = 3 THEN 'R' ELSE 'Q' END AS block
FROM pm WHERE from_idx < 3"""))
def q_canonical_form(spark, d):
    return markov.canonical_form(pf(spark, d).P)


@register("fundamental_matrix", B(ABSORB_CTES, f"""
SELECT {SN.format(c='i')} AS from_state, {SN.format(c='j')} AS to_state, round(v, 6) AS n_visits FROM nm"""))
def q_fundamental_matrix(spark, d):
    return markov.fundamental_matrix(pf(spark, d).P)


@register("time_to_absorption", B(ABSORB_CTES, f"""
SELECT {SN.format(c='i')} AS risk_state, round(b, 6) AS absorption_probability,
       round(t, 2) AS expected_months_to_default, round(t / 12.0, 2) AS expected_years_to_default FROM tt"""))
def q_time_to_absorption(spark, d):
    return markov.time_to_absorption(pf(spark, d).P)


ABSORB_COLS = f"""{SN.format(c='i')} AS state, round(b, 4) AS probability, round(t, 1) AS months,
       round(t / 12.0, 1) AS years, round(v0, 4) AS visits_low, round(v1, 4) AS visits_medium,
       round(v2, 4) AS visits_high, round(p33, 4) AS default_self_transition"""


@register("absorption_summary", B(ABSORB_CTES, f"SELECT {ABSORB_COLS} FROM tt"))
def q_absorption_summary(spark, d):
    return markov.absorption_summary(pf(spark, d).P)


@register("segment_absorption", B(SEG_CTES + "," + absorb_ctes("g_pm", "segment"),
                                  f"SELECT segment, {ABSORB_COLS} FROM tt"))
def q_segment_absorption(spark, d):
    pk = transitions.segment_transition_matrices(pf(spark, d).pairs, packed=True)
    return markov.absorption_summary(pk, by=["segment"])


@register("intervention_urgency", B(ABSORB_CTES, f"""
SELECT {SN.format(c='i')} AS risk_state, round(t, 2) AS expected_months_to_default,
       CASE i WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'HIGH' END AS intervention_urgency FROM tt"""))
def q_intervention_urgency(spark, d):
    t = markov.time_to_absorption(pf(spark, d).P)
    return markov.intervention_urgency(t).select("risk_state", "expected_months_to_default",
                                                 "intervention_urgency")


@register("within_vs_infinite", B(ABSORB_CTES + "," + O.power_cte(36), f"""
SELECT {SN.format(c='pw.i')} AS state, pw.h AS remaining, round(pw.p, 6) AS within_term,
       round(tt.b, 6) AS infinite_horizon
FROM pw LEFT JOIN tt ON tt.i = pw.i WHERE pw.j = 3 AND pw.i <> 3 AND pw.h IN (3, 6, 12, 24, 36)"""))
def q_within_vs_infinite(spark, d):
    return markov.within_vs_infinite(pf(spark, d).P)


def _seg_power_sql(h):
    return SEG_CTES + f""",
spw(segment, h, i, j, p) AS (
  SELECT segment, 1, from_idx, to_idx, p FROM g_pm
  UNION ALL
  SELECT spw.segment, spw.h + 1, spw.i, g.to_idx, sum(spw.p * g.p)
  FROM spw JOIN g_pm g ON g.segment = spw.segment AND spw.j = g.from_idx
  WHERE spw.h < {h} GROUP BY spw.segment, spw.h + 1, spw.i, g.to_idx)"""


@register("segment_forecast", B(_seg_power_sql(6), f"""
SELECT segment, 6 AS horizon,
       round(max(p) FILTER (WHERE i = 2 AND j = 3) OVER (PARTITION BY segment), 4) AS high_to_default,
       {SN.format(c='i')} AS from_state, {SN.format(c='j')} AS to_state, i AS from_idx, j AS to_idx,
       round(p, 4) AS p FROM spw WHERE h = 6"""))
def q_segment_forecast(spark, d):
    pk = transitions.segment_transition_matrices(pf(spark, d).pairs, packed=True)
    return markov.forecast(pk, 6, by=["segment"])


# ---------------------------------------------------------------------------
# Scoring, watchlists (J1-J3, J5, WF1-WF14, T1-T2, A14, E15-E20)
# ---------------------------------------------------------------------------

BAND_POS_SQL = """CASE WHEN raw_bp < 0 THEN 0.0 WHEN raw_bp > 1 THEN 1.0 ELSE raw_bp END"""
RAW_BP_SQL = """CASE WHEN risk_state = 'Low' THEN days_in_arrears / 3.0
          WHEN risk_state = 'Medium' THEN (CASE WHEN days_in_arrears - 5 < 0 THEN 0.0 ELSE days_in_arrears - 5 END) / 24.0
          WHEN risk_state = 'High' THEN (CASE WHEN days_in_arrears - 31 < 0 THEN 0.0 ELSE days_in_arrears - 31 END) / 58.0
          WHEN risk_state = 'Default' THEN (CASE WHEN days_in_arrears / 280.0 > 1 THEN 1.0 ELSE days_in_arrears / 280.0 END)
          ELSE 0.0 END"""


def score_sql(src: str, out: str) -> str:
    """Deterministic scorer over ``src`` (needs risk_state, days_in_arrears, dpd_delta)."""
    def p(j, s):
        return (f"CASE WHEN band IS NULL THEN coalesce(r{j}, 0.0) "
                f"ELSE coalesce(r{j}, 0.0) * 0.5 + (CASE WHEN band = '{s}' THEN 1.0 ELSE 0.0 END) * 0.5 END")
    return f"""
{out}_w AS (SELECT from_state AS fs, max(p) FILTER (WHERE to_idx = 0) AS r0, max(p) FILTER (WHERE to_idx = 1) AS r1,
                 max(p) FILTER (WHERE to_idx = 2) AS r2, max(p) FILTER (WHERE to_idx = 3) AS r3 FROM pm GROUP BY 1),
{out}_a AS (
  SELECT x.*, CASE WHEN proj = 0 THEN 'Low' WHEN proj >= 1 AND proj <= 30 THEN 'Medium'
                   WHEN proj >= 31 AND proj <= 90 THEN 'High' WHEN proj > 90 THEN 'Default' END AS band
  FROM (SELECT s.*, w.r0, w.r1, w.r2, w.r3,
               CASE WHEN days_in_arrears + coalesce(dpd_delta, 0.0) < 0 THEN 0.0
                    ELSE days_in_arrears + coalesce(dpd_delta, 0.0) END AS proj
        FROM {src} s LEFT JOIN {out}_w w ON w.fs = s.risk_state) x),
{out}_b AS (
  SELECT * EXCLUDE (r0, r1, r2, r3, proj, band), {p(0, 'Low')} AS p_low, {p(1, 'Medium')} AS p_medium,
         {p(2, 'High')} AS p_high, {p(3, 'Default')} AS p_default FROM {out}_a),
{out}_c AS (
  SELECT *, CASE WHEN p_low = greatest(p_low, p_medium, p_high, p_default) THEN 'Low'
                 WHEN p_medium = greatest(p_low, p_medium, p_high, p_default) THEN 'Medium'
                 WHEN p_high = greatest(p_low, p_medium, p_high, p_default) THEN 'High' ELSE 'Default' END AS pred
  FROM {out}_b),
{out} AS (
  SELECT *, p_default + p_high AS score,
         CASE pred WHEN 'Low' THEN p_low WHEN 'Medium' THEN p_medium WHEN 'High' THEN p_high ELSE p_default END AS p_pred,
         coalesce(({O.CODE.format(c='pred')}) > ({O.CODE.format(c='risk_state')}), false) AS is_worse
  FROM {out}_c)"""


SNAP_SCORE_CTES = TRAJ_SQL + f""",
mi AS (SELECT observation_month, lag(observation_month) OVER (ORDER BY observation_month) AS prev_month
       FROM (SELECT DISTINCT observation_month FROM verified_out) m),
pmon AS (SELECT prev_month FROM mi WHERE observation_month = '{SNAPSHOT_MONTH}'),
prevrows AS (SELECT loan_id, arg_max(risk_state_code, row_seq) AS pc, arg_max(days_in_arrears, row_seq) AS pd
             FROM verified_out WHERE observation_month = (SELECT prev_month FROM pmon) GROUP BY 1),
streak AS (SELECT loan_id, arg_max(months_in_state, row_seq) AS mis FROM traj
           WHERE observation_month = '{SNAPSHOT_MONTH}' GROUP BY 1),
sf AS (
  SELECT s.*,
    CAST(CASE WHEN (SELECT prev_month FROM pmon) IS NULL THEN s.risk_state_code
              ELSE coalesce(p.pc, s.risk_state_code) END AS INTEGER) AS prev_risk_state_code,
    CASE WHEN (SELECT prev_month FROM pmon) IS NULL THEN s.days_in_arrears ELSE coalesce(p.pd, 0.0) END AS prev_dpd,
    CAST(coalesce(k.mis, 1) AS INTEGER) AS months_in_state
  FROM verified_out s LEFT JOIN prevrows p ON p.loan_id = s.loan_id LEFT JOIN streak k ON k.loan_id = s.loan_id
  WHERE s.observation_month = '{SNAPSHOT_MONTH}'),
sf2 AS (SELECT * EXCLUDE (raw_bp), {BAND_POS_SQL} AS dpd_band_position
        FROM (SELECT *, days_in_arrears - prev_dpd AS dpd_delta, {RAW_BP_SQL} AS raw_bp FROM sf) x),""" + \
    score_sql("sf2", "snap_scored")


def _scored(spark, d):
    from riskflow.operators import scoring
    p = _staged(spark, d)
    return scoring.score_snapshot(p.rows, p.P, SNAPSHOT_MONTH)


SCORE_COLS = ["loan_id", "risk_state", "prev_risk_state_code", "prev_dpd", "dpd_delta", "months_in_state",
              "dpd_band_position", "p_low", "p_medium", "p_high", "p_default", "pred", "score", "p_pred",
              "is_worse"]
_R6 = {"dpd_band_position", "p_low", "p_medium", "p_high", "p_default", "score", "p_pred"}


def _score_select_sql(src):
    return "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _R6 else c for c in SCORE_COLS) + f" FROM {src}"


def _score_select(df):
    return df.select(*[F.round(c, 6).alias(c) if c in _R6 else F.col(c) for c in SCORE_COLS])


@register("scored_snapshot", B(SNAP_SCORE_CTES, _score_select_sql("snap_scored")))
def q_scored_snapshot(spark, d):
    return _score_select(_scored(spark, d))


WATCH_SQL = {
    "about_to_default": "risk_state = 'High' AND p_default >= 0.25",
    "high_risk_any": "risk_state = 'High'",
    "high_to_high": "risk_state = 'High' AND pred = 'High' AND p_default >= 0.10",
    "medium_to_high": "risk_state = 'Medium' AND pred = 'High'",
    "medium_elevated": "risk_state = 'Medium' AND p_default >= 0.10",
    "medium_to_default": "risk_state = 'Medium' AND pred = 'Default'",
    "low_to_medium": "risk_state = 'Low' AND pred = 'Medium'",
    "low_to_high": "risk_state = 'Low' AND pred IN ('High', 'Default')",
    "fast_deterioration": "risk_state <> 'Default' AND pred IN ('High', 'Default')",
    "all_deteriorating": "risk_state <> 'Default' AND is_worse",
    "all_performing": "risk_state <> 'Default'",
    "legacy_about_to_default": "risk_state = 'High' AND pred = 'Default'",
    "legacy_high_to_high": "risk_state = 'High' AND pred = 'High'",
    "legacy_early_warning": "risk_state = 'Low' AND is_worse",
}


def _watch_query(name):
    def run(spark, d):
        from riskflow.operators import watchlist
        return _score_select(watchlist.watch_filter(_scored(spark, d), name))
    return run


for _name, _pred in WATCH_SQL.items():
    register(f"watch_{_name}", B(SNAP_SCORE_CTES, _score_select_sql(f"snap_scored WHERE {_pred}")))(
        _watch_query(_name))

# The same filters over every month with the scorer of the rest of the term, which
# moves accounts of every state: filters that select nothing in one month bite here.
TERM_CTES = O.power_cte(60) + """,
term_x AS (SELECT *, CAST(coalesce(CASE WHEN loan_term_months - loan_age_months < 1 THEN 1.0
                          ELSE loan_term_months - loan_age_months END, 12.0) AS INTEGER) AS remaining_months FROM verified_out),
term_p AS (SELECT h, i, max(p) FILTER (WHERE j = 0) AS p_low, max(p) FILTER (WHERE j = 1) AS p_medium,
                  max(p) FILTER (WHERE j = 2) AS p_high, max(p) FILTER (WHERE j = 3) AS p_default FROM pw GROUP BY 1, 2),
term_y AS (SELECT x.loan_id, x.observation_month, x.risk_state, x.risk_state_code, x.remaining_months, t.p_low, t.p_medium,
                  t.p_high, t.p_default,
                  CASE WHEN t.p_low >= 0.5 THEN 0 WHEN t.p_low + t.p_medium >= 0.5 THEN 1
                       WHEN t.p_low + t.p_medium + t.p_high >= 0.5 THEN 2 ELSE 3 END AS med
           FROM term_x x JOIN term_p t ON t.i = x.risk_state_code AND t.h = least(x.remaining_months, 60)),
term_scored AS (SELECT *, CASE med WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Default' END AS pred,
                       p_default + p_high AS score, med > risk_state_code AS is_worse FROM term_y)"""
TERM_COLS = ["loan_id", "observation_month", "risk_state", "remaining_months", "pred", "p_default", "score", "is_worse"]


def _term_query(name):
    def run(spark, d):
        from riskflow.operators import scoring, watchlist
        p = _staged(spark, d)
        s = scoring.term_scores(features.remaining_months(p.rows), p.P)
        return watchlist.watch_filter(s, name).select(
            *[F.round(c, 6).alias(c) if c in ("p_default", "score") else F.col(c) for c in TERM_COLS])
    return run


for _name, _pred in WATCH_SQL.items():
    register(f"watch_term_{_name}", B(TERM_CTES, "SELECT " + ", ".join(
        f"round({c}, 6) AS {c}" if c in ("p_default", "score") else c for c in TERM_COLS)
        + f" FROM term_scored WHERE {_pred}"))(_term_query(_name))

register("watch_unknown_filter", B(SNAP_SCORE_CTES, _score_select_sql(
    f"snap_scored WHERE {WATCH_SQL['all_performing']}")))(_watch_query("no_such_filter"))


def _page_sql(pred, page, size):
    return B(SNAP_SCORE_CTES, f"""
SELECT loan_id, customer_id, segment, risk_state, pred, CAST(days_in_arrears AS INTEGER) AS days_in_arrears,
       CAST(instalments_in_arrears AS INTEGER) AS instalments_in_arrears, principal_balance,
       round(p_default, 4) AS p_default, round(p_high, 4) AS p_high, round(p_pred, 4) AS p_pred,
       round(score, 4) AS score, is_worse,
       (SELECT count(*) FROM snap_scored WHERE {pred}) AS total,
       CAST(greatest(1, ceil((SELECT count(*) FROM snap_scored WHERE {pred}) / {size}.0)) AS BIGINT) AS total_pages
FROM snap_scored WHERE {pred}
ORDER BY score DESC, loan_id LIMIT {size} OFFSET {(page - 1) * size}""")


@register("watchlist_page", _page_sql(WATCH_SQL["all_deteriorating"], 1, 25))
def q_watchlist_page(spark, d):
    from riskflow.operators import watchlist
    return watchlist.watchlist(_scored(spark, d), "all_deteriorating", 1, 25)


@register("watchlist_page_info", B(SNAP_SCORE_CTES, f"""
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS total_pages, 1000 AS page, 25 AS page_size
FROM snap_scored WHERE {WATCH_SQL["all_deteriorating"]}"""))
def q_watchlist_page_info(spark, d):
    """Totals of a page past the end of the list."""
    from riskflow.operators import watchlist
    return watchlist.page_info(watchlist.watch_filter(_scored(spark, d), "all_deteriorating"), 1000, 25)


@register("watchlist_page_3", _page_sql(WATCH_SQL["all_performing"], 3, 10))
def q_watchlist_page3(spark, d):
    from riskflow.operators import watchlist
    return watchlist.watchlist(_scored(spark, d), "all_performing", 3, 10)


def _summary_sql(where):
    return B(SNAP_SCORE_CTES, "SELECT " + ", ".join(
        f"count(*) FILTER (WHERE pred = '{s}') AS \"{s}\"" for s in ("Low", "Medium", "High", "Default")) +
        f" FROM snap_scored WHERE {where}")


@register("prediction_summary", _summary_sql("true"))
def q_prediction_summary(spark, d):
    from riskflow.operators import watchlist
    return watchlist.prediction_summary(_scored(spark, d))


@register("prediction_summary_filtered", _summary_sql(WATCH_SQL["fast_deterioration"]))
def q_prediction_summary_filtered(spark, d):
    from riskflow.operators import watchlist
    return watchlist.prediction_summary(watchlist.watch_filter(_scored(spark, d), "fast_deterioration"))


@register("high_prob_filter", B(SNAP_SCORE_CTES, """
SELECT loan_id, days_in_arrears, round(p_default, 6) AS p_default FROM snap_scored
WHERE risk_state = 'High' AND p_default > 0.1 ORDER BY p_default DESC, loan_id LIMIT 10"""))
def q_high_prob_filter(spark, d):
    from riskflow.operators import watchlist
    s = _scored(spark, d).filter((F.col("risk_state") == "High") & (F.col("p_default") > 0.1))
    return watchlist.top_n(s, 10, F.col("p_default").desc(), F.col("loan_id")).select(
        "loan_id", "days_in_arrears", F.round("p_default", 6).alias("p_default"))


@register("high_pred_distribution", B(SNAP_SCORE_CTES, """
SELECT pred, count(*) AS n FROM snap_scored WHERE risk_state = 'High' GROUP BY 1"""))
def q_high_pred_distribution(spark, d):
    s = _scored(spark, d).filter(F.col("risk_state") == "High")
    return s.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


@register("horizon_risk", B(SNAP_SCORE_CTES + "," + O.power_cte(3) + """,
hr AS (SELECT i, sum(p) FILTER (WHERE j IN (2, 3)) AS v FROM pw WHERE h = 3 GROUP BY i)""", f"""
SELECT s.loan_id, round(coalesce(hr.v, 0.0), 6) AS horizon_risk,
       round(s.score * 0.6 + coalesce(hr.v, 0.0) * 0.4, 6) AS combined_score,
       s.risk_state || ' → ' || s.pred AS transition_label,
       printf('%.1f%%', coalesce(hr.v, 0.0) * 100.0) AS horizon_risk_text
FROM snap_scored s LEFT JOIN hr ON hr.i = s.risk_state_code"""))
def q_horizon_risk(spark, d):
    from riskflow.operators import watchlist
    p = _staged(spark, d)
    h = markov.horizon_risk_lookup(_scored(spark, d), p.P, horizon=3)
    c = watchlist.combined_score(h)
    return c.select("loan_id", F.round("horizon_risk", 6).alias("horizon_risk"),
                    F.round("combined_score", 6).alias("combined_score"), "transition_label",
                    "horizon_risk_text")


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------

EVAL_CTES = TRAJ_SQL + "," + score_sql("traj", "all_scored") + """,
lab AS (SELECT * FROM all_scored WHERE next_risk_state IS NOT NULL),
tm AS (SELECT observation_month FROM (SELECT DISTINCT observation_month FROM lab) m
       ORDER BY observation_month DESC LIMIT 2),
split AS (SELECT *, CASE WHEN observation_month IN (SELECT observation_month FROM tm) THEN 'test'
                         ELSE 'train' END AS split FROM lab),
test AS (SELECT * FROM split WHERE split = 'test'),
train AS (SELECT * FROM split WHERE split = 'train')"""


def _eval(spark, d):
    from riskflow.operators import scoring
    p = _staged(spark, d)
    return scoring.deterministic_scores(p.featured, p.P)


def _split(spark, d):
    return evaluate.time_split(_eval(spark, d))


def _test(spark, d):
    return evaluate.train_test(_eval(spark, d))[1]


@register("time_split", B(EVAL_CTES, """
SELECT split, count(*) AS n_rows, count(DISTINCT observation_month) AS n_months FROM split GROUP BY 1"""))
def q_time_split(spark, d):
    return _split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                                 F.countDistinct("observation_month").alias("n_months"))


@register("confusion_matrix", B(EVAL_CTES, """
SELECT g.from_state AS actual, g.to_state AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN (SELECT next_risk_state, pred, count(*) AS n FROM test GROUP BY 1, 2) c
  ON c.next_risk_state = g.from_state AND c.pred = g.to_state"""))
def q_confusion(spark, d):
    return evaluate.confusion_matrix(_test(spark, d))


CONF_NORM = """
cn AS (
  SELECT g.from_state, g.to_state, g.from_idx, g.to_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n_pairs
  FROM grid g LEFT JOIN (SELECT {a} AS a, {p} AS p, count(*) AS n FROM {src} GROUP BY 1, 2) c
    ON c.a = g.from_state AND c.p = g.to_state),
cnp AS (SELECT *, CASE WHEN sum(n_pairs) OVER (PARTITION BY from_state) = 0 THEN 0.0
                  ELSE n_pairs / CAST(sum(n_pairs) OVER (PARTITION BY from_state) AS DOUBLE) END AS pc FROM cn)"""


@register("row_normalised_confusion", B(EVAL_CTES + "," + CONF_NORM.format(a="next_risk_state", p="pred",
                                                                           src="test"), """
SELECT from_state, to_state, from_idx, to_idx, n_pairs, pc AS p FROM cnp"""))
def q_row_norm_conf(spark, d):
    return transitions.to_long(evaluate.row_normalised_confusion(_test(spark, d)))


@register("empirical_matrix", B(EVAL_CTES + "," + CONF_NORM.format(a="risk_state", p="next_risk_state",
                                                                   src="test"), """
SELECT from_state, to_state, from_idx, to_idx, n_pairs, pc AS p FROM cnp"""))
def q_empirical_matrix(spark, d):
    return transitions.to_long(evaluate.empirical_matrix(_test(spark, d)))


@register("transition_mae", B(EVAL_CTES + "," + CONF_NORM.format(a="next_risk_state", p="pred", src="test"), """
SELECT round(avg(abs(c.pc - m.p)), 4) AS transition_mae
FROM cnp c JOIN pm m ON m.from_idx = c.from_idx AND m.to_idx = c.to_idx"""))
def q_transition_mae(spark, d):
    return evaluate.transition_mae(_test(spark, d), _staged(spark, d).P)


def _class_report_sql(src, a, p):
    return f"""
cr AS (
  SELECT s.state AS label, s.idx,
         count(*) FILTER (WHERE t.{a} = s.state AND t.{p} = s.state) AS tp,
         count(*) FILTER (WHERE t.{p} = s.state) AS pp, count(*) FILTER (WHERE t.{a} = s.state) AS ap
  FROM st s, {src} t GROUP BY 1, 2),
cr2 AS (SELECT label, tp, pp, ap,
               CASE WHEN pp > 0 THEN tp / CAST(pp AS DOUBLE) ELSE 0.0 END AS prec,
               CASE WHEN ap > 0 THEN tp / CAST(ap AS DOUBLE) ELSE 0.0 END AS rec FROM cr),
cr3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM cr2)"""


@register("class_report", B(EVAL_CTES + "," + _class_report_sql("test", "next_risk_state", "pred"), """
SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
       CAST(ap AS BIGINT) AS support FROM cr3
UNION ALL
SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(ap) AS BIGINT)
FROM cr3 WHERE ap > 0 OR pp > 0
UNION ALL
SELECT 'accuracy', NULL, NULL, round(count(*) FILTER (WHERE next_risk_state = pred) / CAST(count(*) AS DOUBLE), 6),
       CAST(count(*) AS BIGINT) FROM test"""))
def q_class_report(spark, d):
    return evaluate.class_report(_test(spark, d))


@register("threshold_sweep", B(EVAL_CTES, """
SELECT t AS threshold,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END, 6) AS recall_high,
  round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 6) AS precision_high,
  CAST(tp + fp AS BIGINT) AS n_flagged
FROM (SELECT v.t,
        count(*) FILTER (WHERE p_high >= v.t AND next_risk_state = 'High') AS tp,
        count(*) FILTER (WHERE p_high >= v.t AND next_risk_state <> 'High') AS fp,
        count(*) FILTER (WHERE p_high < v.t AND next_risk_state = 'High') AS fn
      FROM (SELECT CAST(t AS DOUBLE) AS t FROM (VALUES (0.15), (0.2), (0.25), (0.3), (0.35), (0.4), (0.45), (0.5)) AS v0(t)) v, test
      GROUP BY v.t) x"""))
def q_threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_test(spark, d))


@register("recall_by_current_state", B(EVAL_CTES, """
SELECT risk_state, count(*) AS n, count(*) FILTER (WHERE p_high >= 0.5) AS caught_050,
       count(*) FILTER (WHERE p_high >= 0.25) AS caught_025
FROM test WHERE next_risk_state = 'High' GROUP BY 1"""))
def q_recall_by_state(spark, d):
    return evaluate.recall_by_current_state(_test(spark, d))


PROJ_BAND_SQL = """coalesce(CASE WHEN projected_dpd_next = 0 THEN 'Low'
  WHEN projected_dpd_next >= 1 AND projected_dpd_next <= 30 THEN 'Medium'
  WHEN projected_dpd_next >= 31 AND projected_dpd_next <= 90 THEN 'High'
  WHEN projected_dpd_next > 90 THEN 'Default' END, risk_state)"""

MODELS_CTE = f"""
mods AS (
  SELECT 'scorer' AS model, 1 AS model_order, next_risk_state AS a, pred AS p FROM test
  UNION ALL SELECT 'persistence', 2, next_risk_state, risk_state FROM test
  UNION ALL SELECT 'dpd_projection', 3, next_risk_state, {PROJ_BAND_SQL} FROM test),
mc AS (
  SELECT m.model, m.model_order, s.state,
         count(*) FILTER (WHERE m.a = s.state AND m.p = s.state) AS tp,
         count(*) FILTER (WHERE m.p = s.state) AS pp, count(*) FILTER (WHERE m.a = s.state) AS ap
  FROM mods m, st s GROUP BY 1, 2, 3),
mc2 AS (SELECT *, CASE WHEN pp > 0 THEN tp / CAST(pp AS DOUBLE) ELSE 0.0 END AS prec,
               CASE WHEN ap > 0 THEN tp / CAST(ap AS DOUBLE) ELSE 0.0 END AS rec FROM mc),
mc3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM mc2),
mm AS (SELECT model, model_order, avg(f1) FILTER (WHERE ap > 0 OR pp > 0) AS macro_f1,
              max(rec) FILTER (WHERE state = 'High') AS recall_high,
              max(rec) FILTER (WHERE state = 'Medium') AS recall_medium FROM mc3 GROUP BY 1, 2)"""


@register("model_comparison", B(EVAL_CTES + "," + MODELS_CTE, """
SELECT model, round(macro_f1, 6) AS macro_f1, round(recall_high, 6) AS recall_high,
       round(recall_medium, 6) AS recall_medium,
       round(macro_f1 * 0.5 + recall_high * 0.25 + recall_medium * 0.25, 6) AS composite,
       row_number() OVER (ORDER BY macro_f1 * 0.5 + recall_high * 0.25 + recall_medium * 0.25 DESC,
                          model_order) = 1 AS is_best
FROM mm"""))
def q_model_comparison(spark, d):
    t = _test(spark, d)
    preds = {"scorer": F.col("pred"), "persistence": F.col("risk_state"),
             "dpd_projection": F.coalesce(state_from_dpd("projected_dpd_next", None), F.col("risk_state"))}
    return evaluate.model_comparison(evaluate.compare_models(t, preds))


MT_CTES = """
nx AS (SELECT pred, lead(pred) OVER (PARTITION BY loan_id ORDER BY observation_month, row_seq) AS np
       FROM all_scored),
mt AS (
  SELECT g.from_state, g.to_state, g.from_idx, g.to_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n_pairs
  FROM grid g LEFT JOIN (SELECT pred, np, count(*) AS n FROM nx WHERE np IS NOT NULL GROUP BY 1, 2) c
    ON c.pred = g.from_state AND c.np = g.to_state),
mtp AS (SELECT *, CASE WHEN sum(n_pairs) OVER (PARTITION BY from_state) = 0 THEN 0.0
                  ELSE n_pairs / CAST(sum(n_pairs) OVER (PARTITION BY from_state) AS DOUBLE) END AS p FROM mt)"""


@register("model_transition_matrix", B(EVAL_CTES + "," + MT_CTES, """
SELECT from_state, to_state, from_idx, to_idx, n_pairs, p FROM mtp"""))
def q_model_transition_matrix(spark, d):
    return transitions.to_long(transitions.model_transition_matrix(_eval(spark, d), "pred", bounded=pf(spark, d).bounded))


@register("compare_matrices", B(EVAL_CTES + "," + MT_CTES, """
SELECT 'scorer' AS model, round(avg(abs(a.p - b.p)), 4) AS mae,
       round(max(a.p) FILTER (WHERE a.from_idx = 2 AND a.to_idx = 3), 4) AS high_to_default,
       round(max(a.p) FILTER (WHERE a.from_idx = 1 AND a.to_idx = 2), 4) AS medium_to_high,
       round(max(a.p) FILTER (WHERE a.from_idx = 3 AND a.to_idx = 3), 4) AS default_persist
FROM mtp a JOIN pm b ON a.from_idx = b.from_idx AND a.to_idx = b.to_idx"""))
def q_compare_matrices(spark, d):
    m = transitions.model_transition_matrix(_eval(spark, d), "pred", bounded=pf(spark, d).bounded).select(F.lit("scorer").alias("model"), "P")
    return transitions.compare_matrices(_staged(spark, d).P, m)


@register("class_weights", B(EVAL_CTES, """
SELECT next_risk_state, round(n_all / (k * CAST(nc AS DOUBLE)), 6) AS weight
FROM (SELECT next_risk_state, count(*) AS nc FROM train GROUP BY 1) c,
     (SELECT count(*) AS n_all, count(DISTINCT next_risk_state) AS k FROM train) t"""))
def q_class_weights(spark, d):
    tr = evaluate.train_test(_eval(spark, d))[0]
    w = evaluate.class_weights(tr)
    return w.select("next_risk_state", F.round("weight", 6).alias("weight")).distinct()


@register("label_encoding", B(EVAL_CTES, """
SELECT 'segment' AS "column", value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT segment AS value FROM train WHERE segment IS NOT NULL) s
UNION ALL
SELECT 'loan_type', value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER)
FROM (SELECT DISTINCT loan_type AS value FROM train WHERE loan_type IS NOT NULL) l"""))
def q_label_encoding(spark, d):
    tr = evaluate.train_test(_eval(spark, d))[0]
    a = evaluate.label_encoding(tr, "segment").select(F.lit("segment").alias("column"), "value", "code")
    b = evaluate.label_encoding(tr, "loan_type").select(F.lit("loan_type").alias("column"), "value", "code")
    return a.unionByName(b)


# the latest month's branches, some with a name that training has not seen
BRANCH_SQL = "CASE WHEN branch_name = 'BR3' THEN 'BR-NEW' ELSE branch_name END"


@register("safe_encode", B(EVAL_CTES, f"""
SELECT s.loan_id, s.branch, coalesce(e.code, 0) AS branch_enc
FROM (SELECT loan_id, {BRANCH_SQL} AS branch FROM verified_out WHERE observation_month = '{SNAPSHOT_MONTH}') s
LEFT JOIN (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT branch_name AS value FROM train WHERE branch_name IS NOT NULL) x) e
  ON e.value = coalesce(s.branch, 'nan')"""))
def q_safe_encode(spark, d):
    enc = evaluate.label_encoding(evaluate.train_test(_eval(spark, d))[0], "branch_name")
    snap = overview.snapshot(pf(spark, d).rows, SNAPSHOT_MONTH)
    snap = snap.withColumn("branch", F.expr(BRANCH_SQL))
    return evaluate.safe_encode(snap, "branch", enc).select("loan_id", "branch", "branch_enc")


STD_FEATS = ["days_in_arrears", "dpd_delta", "months_in_state"]


@register("standardise", B(EVAL_CTES, "SELECT loan_id, observation_month, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) OVER () END, 6) AS {c}_std" for c in STD_FEATS) + " FROM test"))
def q_standardise(spark, d):
    s = evaluate.standardise(_test(spark, d), STD_FEATS)
    return s.select("loan_id", "observation_month", *[F.round(f"{c}_std", 6).alias(f"{c}_std") for c in STD_FEATS])


# ---------------------------------------------------------------------------
# MLlib models (L1-L15, A26, E22, E24, J8) — rows-only checks
# ---------------------------------------------------------------------------

def _ml_sets(spark, d):
    from riskflow.operators import ml
    train, test = evaluate.train_test(_written(spark, d))
    enc = _once(spark, d, "encodings", lambda: {c: write_stage(e, f"enc-{c}") for c, e in ml.fit_encodings(train).items()})
    return ml.apply_encodings(train, enc), ml.apply_encodings(test, enc), enc


def _training_set(spark, d):
    """Real and synthetic rows before balancing."""
    from riskflow.operators import ml
    train, _, _ = _ml_sets(spark, d)
    feats = ml.NOTEBOOK_FEATURES
    return ml.append_synthetic(train, ml.augment_high(train, feats), feats)


def _model(spark, d, kind):
    """Fit once per application, data and kind: trees from the written training table,
    the logistic model from its own blocks of the augmented rows, the only form it writes
    them in. The fitted model is reused by the prediction and explanation queries."""
    from riskflow.operators import ml
    feats = ml.NOTEBOOK_FEATURES

    def fit():
        if kind == "logistic":
            return ml.fit_logistic(_training_set(spark, d), feats)
        rows = _once(spark, d, "augmented", lambda: write_stage(_training_set(spark, d), "augmented"))
        table = _once(spark, d, "training", lambda: ml.training_table(rows, feats, written=True))
        if kind == "forest":
            return ml.fit_forest(table, feats, **FOREST_PARAMS)
        return ml.fit_boosted(table, feats, **BOOSTED_PARAMS)
    return _once(spark, d, kind, fit)


# Model sizes used by the registered queries. The operator defaults follow the
# reference (300 trees of unlimited depth, 300 boosting rounds); the registered
# queries train smaller models on all rows so that the per-query check finishes
# (figures of the larger sizes at sf0.01 are in the README).
FOREST_PARAMS: dict = {"num_trees": 50, "max_depth": 12}
BOOSTED_PARAMS: dict = {"rounds": 20, "depth": 6}

PRED_OUT = ["loan_id", "observation_month", "risk_state", "next_risk_state", "pred", "p_low", "p_medium",
            "p_high", "p_default", "score", "p_pred", "is_worse", "early_warning_high"]


@register("augment_high_balance", B(EVAL_CTES, """
SELECT next_risk_state, false AS synthetic, count(*) AS n FROM train GROUP BY 1
UNION ALL SELECT 'High', true, 4 * count(*) FROM train WHERE next_risk_state = 'High' HAVING count(*) > 0"""))
def q_augment_balance(spark, d):
    return _training_set(spark, d).groupBy("next_risk_state", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("smote_balance", B(EVAL_CTES + """,
sizes AS (SELECT next_risk_state, count(*) * CASE WHEN next_risk_state = 'High' THEN 5 ELSE 1 END AS n
          FROM train WHERE next_risk_state IS NOT NULL GROUP BY 1)""", """
SELECT next_risk_state, (SELECT max(n) FROM sizes) - n AS n_synthetic, 0 AS n_outside FROM sizes
WHERE n < (SELECT max(n) FROM sizes)"""))
def q_smote_balance(spark, d):
    """L5 on the augmented set: synthetic rows per class, and how many lie
    outside the range of their class in any feature (none can)."""
    from riskflow.operators import ml, smote
    feats = ml.NOTEBOOK_FEATURES
    table = _once(spark, d, "augmented", lambda: write_stage(_training_set(spark, d), "augmented"))
    ranges = table.groupBy("next_risk_state").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in feats for f in (F.min, F.max)])
    new = smote.smote(table, feats).join(F.broadcast(ranges), "next_risk_state")     # a row per state
    outside = [(F.col(c) < F.col(f"min_{c}") - 1e-6 - F.abs(f"min_{c}") * 1e-9)
               | (F.col(c) > F.col(f"max_{c}") + 1e-6 + F.abs(f"max_{c}") * 1e-9) for c in feats]
    out = outside[0]
    for o in outside[1:]:
        out = out | o
    return new.groupBy("next_risk_state").agg(F.count(F.lit(1)).alias("n_synthetic"),
                                              F.count_if(out).cast("int").alias("n_outside"))


@register("augment_high_draws", B(EVAL_CTES + """,
high AS (SELECT loan_id, observation_month,
           md5('42|' || loan_id || '|' || observation_month || '|' || CAST(row_seq AS VARCHAR)) AS k
         FROM train WHERE next_risk_state = 'High'),
ranked AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS rnk FROM high),
drawn AS (SELECT ('0x' || substr(md5('42|draw|' || CAST(i AS VARCHAR)), 1, 15))::BIGINT
                   % (SELECT count(*) FROM high) AS rnk, count(*) AS n
          FROM range(4 * (SELECT count(*) FROM high)) t(i) GROUP BY 1)""", """
SELECT loan_id, observation_month, coalesce(n, 0) AS n_drawn FROM ranked LEFT JOIN drawn USING (rnk)"""))
def q_augment_draws(spark, d):
    """L4: how often each High row is drawn."""
    from riskflow.operators import ml
    train, _ = evaluate.train_test(_written(spark, d))
    high = write_stage(train.filter("next_risk_state = 'High'").select("loan_id", "observation_month", ROW_SEQ), "high")
    drawn = ml.draw_with_replacement(high, ml.AUG_MULTIPLIER).groupBy("loan_id", "observation_month", ROW_SEQ) \
        .agg(F.count(F.lit(1)).alias("n_drawn"))
    return high.join(drawn, ["loan_id", "observation_month", ROW_SEQ], "left").select(
        "loan_id", "observation_month", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"))


def _ml_predictions(kind):
    def run(spark, d):
        from riskflow.operators import ml
        _, test, _ = _ml_sets(spark, d)
        return ml.predict_batch(_model(spark, d, kind), test).select(*PRED_OUT)
    return run


for _kind in ("logistic", "forest", "boosted"):
    register(f"ml_{_kind}_predictions")(_ml_predictions(_kind))


@register("ml_logistic_class_report")
def q_ml_class_report(spark, d):
    return evaluate.class_report(_ml_predictions("logistic")(spark, d))


@register("ml_logistic_threshold_sweep")
def q_ml_sweep(spark, d):
    return evaluate.threshold_sweep(_ml_predictions("logistic")(spark, d))


def _snapshot_features(spark, d):
    from riskflow.operators import ml
    _, _, enc = _ml_sets(spark, d)
    snap = _written(spark, d).filter(F.col("observation_month") == SNAPSHOT_MONTH)
    return ml.apply_encodings(snap, enc)


@register("ml_predict_account")
def q_ml_predict_account(spark, d):
    from riskflow.operators import ml
    _, _, enc = _ml_sets(spark, d)
    latest = account.latest_match(account.account_search(_written(spark, d), SEARCH_TEXT))
    return ml.predict_account(_model(spark, d, "logistic"), ml.apply_encodings(latest, enc))


@register("ml_explain_top5")
def q_ml_explain(spark, d):
    from riskflow.operators import ml
    _, _, enc = _ml_sets(spark, d)
    m = _model(spark, d, "logistic")
    latest = ml.apply_encodings(account.latest_match(account.account_search(_written(spark, d),
                                                                            SEARCH_TEXT)), enc)
    scored = ml.predict_batch(m, latest).select("loan_id", "pred")
    c = ml.linear_contributions(m, latest, ["loan_id"])
    mine = c.join(scored, "loan_id").filter(F.col("class") == F.col("pred"))
    return ml.driver_direction(ml.explain_top(mine, ["loan_id", "pred"], n=5))


@register("ml_global_importance")
def q_ml_importance(spark, d):
    from riskflow.operators import ml
    m = _model(spark, d, "logistic")
    return ml.global_importance(ml.linear_contributions(m, _snapshot_features(spark, d), ["loan_id"]), "Default")


@register("ml_watchlist_top3")
def q_ml_watchlist_top3(spark, d):
    from riskflow.operators import ml, watchlist
    m = _model(spark, d, "logistic")
    scored = ml.predict_batch(m, _snapshot_features(spark, d))
    ranked = watchlist.watch_filter(scored, "all_performing")
    drivers = ml.top_drivers_text(ml.linear_contributions(m, ranked, ["loan_id"]), ["loan_id"])
    return ranked.select("loan_id", "risk_state", "pred", "score").join(drivers, "loan_id", "left")


@register("sample_rows", B("", """
SELECT loan_id, observation_month, risk_state FROM verified_out
ORDER BY md5('42|' || loan_id || '|' || observation_month || '|' || CAST(row_seq AS VARCHAR)), loan_id LIMIT 100"""))
def q_sample_rows(spark, d):
    from riskflow.operators import ml
    return ml.sample_rows(pf(spark, d).rows, 100).select("loan_id", "observation_month", "risk_state")


@register("ml_boosted_explain_top5")
def q_ml_boosted_explain(spark, d):
    """L13 for the boosted model: exact TreeSHAP, top 5 for the predicted state."""
    from riskflow.operators import ml, treeshap
    _, _, enc = _ml_sets(spark, d)
    m = _model(spark, d, "boosted")
    latest = ml.apply_encodings(account.latest_match(account.account_search(_written(spark, d),
                                                                            SEARCH_TEXT)), enc)
    scored = ml.predict_batch(m, latest).select("loan_id", "pred")
    c = treeshap.tree_contributions(m, latest, ["loan_id"])
    mine = c.join(scored, "loan_id").filter(F.col("class") == F.col("pred"))
    return ml.driver_direction(ml.explain_top(mine, ["loan_id", "pred"], n=5))


@register("ml_boosted_global_importance")
def q_ml_boosted_importance(spark, d):
    """A26 for the boosted model over the whole snapshot."""
    from riskflow.operators import ml, treeshap
    m = _model(spark, d, "boosted")
    return ml.global_importance(treeshap.tree_contributions(m, _snapshot_features(spark, d), ["loan_id"]), "Default")


@register("ml_forest_explain_top5")
def q_ml_forest_explain(spark, d):
    """L13 for the forest: exact TreeSHAP of the class probabilities, top 5
    for the predicted state of the searched account."""
    from riskflow.operators import ml, treeshap
    _, _, enc = _ml_sets(spark, d)
    m = _model(spark, d, "forest")
    latest = ml.apply_encodings(account.latest_match(account.account_search(_written(spark, d),
                                                                            SEARCH_TEXT)), enc)
    scored = ml.predict_batch(m, latest).select("loan_id", "pred")
    c = treeshap.tree_contributions(m, latest, ["loan_id"])
    mine = c.join(scored, "loan_id").filter(F.col("class") == F.col("pred"))
    return ml.driver_direction(ml.explain_top(mine, ["loan_id", "pred"], n=5))
