"""Snapshot trajectory features (J1-J3) and the deterministic scorer.

``score_snapshot`` produces the columns every watchlist/evaluation operator
reads — ``pred, p_low, p_medium, p_high, p_default, score, p_pred, is_worse``.
A fitted MLlib model produces the same columns (see ``riskflow.operators.ml``),
so the two are interchangeable downstream.

Deterministic scorer (exact, SQL-checkable): each state's probability is
half the empirical transition row of the current state and half a point mass
on the band of the projected next-month DPD (the row alone when that
projection falls between bands).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import clip_lower, dpd_band_position, state_from_dpd
from riskflow.functions.matrix import mat_get
from riskflow.operators.features import TRAJECTORY_COLUMNS, trajectory_features
from riskflow.schema import ROW_SEQ
from riskflow.states import STATES, state_code

PROB_COLS = ["p_low", "p_medium", "p_high", "p_default"]

def prev_month_join(snap: DataFrame, panel: DataFrame, month: str) -> DataFrame:
    """Previous-*panel*-month state and DPD per loan.

    The previous existing month is a scalar subquery (max month below
    ``month``), so on a month-partitioned panel only that partition is read.
    First panel month -> own state / own DPD; a loan absent last month ->
    own code and DPD 0. Duplicate (loan, month) rows on the right are reduced
    to the last ingested one so the left join cannot fan out.
    """
    prev_m = panel.filter(F.col("observation_month") < month) \
        .agg(F.max("observation_month").alias("_pm")).scalar()
    code = state_code("risk_state")
    prev = (panel.filter(F.col("observation_month") == prev_m)
                 .groupBy("loan_id")
                 .agg(F.max_by(F.struct(code.alias("c"), F.col("days_in_arrears").alias("d")),
                               F.col(ROW_SEQ)).alias("_p")))
    s = snap if "risk_state_code" in snap.columns else snap.withColumn("risk_state_code", code)
    j = s.join(prev, "loan_id", "left").withColumn("_prev_month", prev_m)
    first = F.col("_prev_month").isNull()
    prev_code = F.when(first, F.col("risk_state_code")).otherwise(
        F.coalesce(F.col("_p.c"), F.col("risk_state_code"))).cast("int")
    prev_dpd = F.when(first, F.col("days_in_arrears")).otherwise(F.coalesce(F.col("_p.d"), F.lit(0.0)))
    return (j.withColumn("prev_risk_state_code", prev_code)
             .withColumn("prev_dpd", prev_dpd)
             .withColumn("dpd_delta", F.col("days_in_arrears") - F.col("prev_dpd"))
             .drop("_p", "_prev_month"))


def streak_join(snap: DataFrame, panel: DataFrame, month: str) -> DataFrame:
    """J2 + J3: months_in_state at ``month`` from the history of the
    snapshot's loans, null -> 1. A featured panel already stores the streak
    (computed in the panel's single per-loan window pass), so only the
    ``month`` partition is read; otherwise the history up to ``month`` of the
    snapshot's loans (semi-join) goes through the loan window."""
    if "months_in_state" in panel.columns:
        t = panel.filter(F.col("observation_month") == month)
    else:
        hist = panel.filter(F.col("observation_month") <= month) \
            .join(snap.select("loan_id").distinct(), "loan_id", "left_semi")
        t = trajectory_features(hist).filter(F.col("observation_month") == month)
    t = t.groupBy("loan_id").agg(F.max_by("months_in_state", F.col(ROW_SEQ)).alias("_mis"))
    return snap.join(t, "loan_id", "left") \
        .withColumn("months_in_state", F.coalesce(F.col("_mis"), F.lit(1)).cast("int")).drop("_mis")


def snapshot_features(snap: DataFrame, panel: DataFrame, month: str) -> DataFrame:
    """J1 + J2 + E4 for a one-month snapshot (the scoring-time features)."""
    d = prev_month_join(snap, panel, month)
    d = streak_join(d, panel, month)
    return d.withColumn("dpd_band_position", dpd_band_position("risk_state", "days_in_arrears"))

def deterministic_scores(feat: DataFrame, packed: DataFrame, states: list[str] = STATES) -> DataFrame:
    """p_s = 0.5 * P[current, s] + 0.5 * [band(projected DPD) = s].

    The probabilities are one array column (``_probs``) so that the argmax,
    ``p_pred`` and ``is_worse`` read it instead of re-inlining the scorer."""
    k = len(states)
    d = feat.withColumn("_P", packed.select("P").scalar())
    cur = state_code("risk_state", states)
    proj = clip_lower(F.col("days_in_arrears") + F.coalesce(F.col("dpd_delta"), F.lit(0.0)), 0.0)
    band = state_code(state_from_dpd(proj, unknown=None), states)
    d = d.withColumn("_band", band).withColumn("_row", F.get(F.col("_P"), cur))

    def prob(j):
        rp = F.coalesce(F.get(F.col("_row"), j), F.lit(0.0))
        hit = F.when(F.col("_band") == j, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(F.col("_band").isNull(), rp).otherwise(rp * 0.5 + hit * 0.5)
    d = d.withColumn("_probs", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), prob))
    d = d.select(*[c for c in d.columns if c not in ("_P", "_band", "_row")],
                 *[F.get(F.col("_probs"), F.lit(i)).alias(c) for i, c in enumerate(PROB_COLS)])
    return with_prediction_columns(d, states)


def with_prediction_columns(d: DataFrame, states: list[str] = STATES) -> DataFrame:
    """pred = argmax (first state wins a tie), score, p_pred, is_worse."""
    if "_probs" not in d.columns:
        d = d.withColumn("_probs", F.array(*[F.col(c) for c in PROB_COLS]))
    d = d.withColumn("_pi", F.array_position(F.col("_probs"), F.array_max(F.col("_probs"))).cast("int"))
    labels = F.array(*[F.lit(s) for s in states])
    d = d.select(
        "*",
        F.element_at(labels, F.col("_pi")).alias("pred"),
        (F.col("p_default") + F.col("p_high")).alias("score"),
        F.coalesce(F.element_at(F.col("_probs"), F.col("_pi")), F.lit(0.0)).alias("p_pred"),
        F.coalesce((F.col("_pi") - 1) > state_code("risk_state", states), F.lit(False)).alias("is_worse"))
    return d.drop("_probs", "_pi")


def score_snapshot(panel: DataFrame, packed: DataFrame, month: str,
                   segment: str | None = "All Segments") -> DataFrame:
    """Snapshot -> J1/J2/E4 features -> deterministic probabilities."""
    from riskflow.operators.overview import snapshot
    snap = snapshot(panel, month, segment)
    snap = snap.drop(*[c for c in TRAJECTORY_COLUMNS if c in snap.columns])
    return deterministic_scores(snapshot_features(snap, panel, month), packed)


def term_scores(accounts: DataFrame, packed: DataFrame, cap: int = 60, states: list[str] = STATES) -> DataFrame:
    """A deterministic scorer over the rest of an account's term: the
    probabilities are the row of P^h of its state, h = min(remaining months,
    cap), and ``pred`` is the median state (the first whose cumulated
    probability reaches one half). An account may so move up or down from any
    state. The lookup has k * cap rows, a size fixed by the parameters."""
    from riskflow.operators.markov import power_table
    k = len(states)
    cells = power_table(packed, cap, None, states).groupBy(F.col("from_state").alias("_s"), F.col("n").alias("_n")).agg(
        *[F.max(F.when(F.col("to_idx") == i, F.col("p"))).alias(c) for i, c in enumerate(PROB_COLS[:k])])
    acc = accounts.withColumn("_h", F.least(F.col("remaining_months"), F.lit(cap)))
    d = acc.join(F.broadcast(cells), (F.col("risk_state") == F.col("_s")) & (F.col("_h") == F.col("_n")), "left") \
           .drop("_s", "_n", "_h")
    half, upto, at = F.lit(None).cast("int"), F.lit(0.0), F.lit(None).cast("int")
    for i, c in enumerate(PROB_COLS[:k]):
        upto = upto + F.col(c)
        half = F.when(upto >= 0.5, F.lit(i)) if i == 0 else half.when(upto >= 0.5, F.lit(i))
    at = half.otherwise(F.when(F.col(PROB_COLS[0]).isNotNull(), F.lit(k - 1)))
    d = d.withColumn("_at", at)
    labels, probs = F.array(*[F.lit(s) for s in states]), F.array(*[F.col(c) for c in PROB_COLS[:k]])
    return d.select(
        *[c for c in d.columns if c != "_at"], F.get(labels, F.col("_at")).alias("pred"),
        (F.col("p_default") + F.col("p_high")).alias("score"),
        F.coalesce(F.get(probs, F.col("_at")), F.lit(0.0)).alias("p_pred"),
        F.coalesce(F.col("_at") > state_code("risk_state", states), F.lit(False)).alias("is_worse"))
