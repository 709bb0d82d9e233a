"""Per-loan trajectory features (W2-W7) and scalar features.

All per-loan features come from one pass over neighbouring rows
(:mod:`riskflow.operators.sequence`), whatever subset is requested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.columns import (between_flag, clip, clip_lower, dpd_band_position,
                                        lifecycle_stage, safe_ratio_clip)
from riskflow.operators.sequence import with_neighbours
from riskflow.schema import ROW_SEQ
from riskflow.states import state_code

TRAJECTORY_COLUMNS = [
    "prev_risk_state_code", "prev_dpd", "dpd_delta", "prev_dpd_2m", "dpd_velocity_2m",
    "prev_dpd_3m", "dpd_velocity_3m", "months_in_state", "dpd_band_position",
    "projected_dpd_next", "proj_will_be_high", "proj_will_be_default", "proj_will_be_medium",
    "proj_will_be_low", "smooth_velocity", "smooth_proj_dpd", "smooth_proj_high",
    "smooth_proj_default", "transitioning_up", "transitioning_down", "near_high_threshold",
    "near_default_threshold", "near_medium_threshold",
]


def trajectory_features(df: DataFrame, key: str = "loan_id",
                        order=("observation_month", ROW_SEQ), with_next: bool = False,
                        bounded: bool = False) -> DataFrame:
    """W2-W5 + E4-E10 over the whole panel (previous *row*, gaps collapse).
    ``with_next`` adds the next state (W1) from the same pass; ``bounded`` as in
    :func:`riskflow.operators.sequence.with_neighbours`."""
    if "risk_state_code" not in df.columns:
        df = df.withColumn("risk_state_code", state_code("risk_state"))
    n = with_neighbours(df, {"state": "risk_state", "code": "risk_state_code", "dpd": "days_in_arrears"}, lags=3,
                        lead=with_next, run_of="state", key=key, order=order, bounded=bounded)
    return from_neighbours(n, df.columns, with_next)


def from_neighbours(n: DataFrame, columns: list[str], with_next: bool = False) -> DataFrame:
    """``columns`` and the features of W2-W5 and E4-E10 from the rows' neighbours."""
    nxt = [F.col("_next.state").alias("next_risk_state"), F.col("_next.code").alias("next_risk_state_code")]
    base = n.select(
        *columns, *(nxt if with_next else []),
        F.coalesce(F.col("_lag1.code"), F.col("risk_state_code")).cast("int").alias("prev_risk_state_code"),
        F.coalesce(F.col("_lag1.dpd"), F.lit(0.0)).alias("prev_dpd"),
        F.coalesce(F.col("_lag2.dpd"), F.lit(0.0)).alias("prev_dpd_2m"),
        F.coalesce(F.col("_lag3.dpd"), F.lit(0.0)).alias("prev_dpd_3m"),
        F.col("_run").alias("months_in_state"))
    return add_dpd_features(base)


def add_dpd_features(df: DataFrame) -> DataFrame:
    """E4-E10 from dpd, prev_dpd, prev_dpd_2m/3m, codes (three projections,
    so the plan is analysed three times rather than once per column)."""
    dpd = F.col("days_in_arrears")
    keep = [c for c in df.columns if c not in TRAJECTORY_COLUMNS or c in (
        "prev_risk_state_code", "prev_dpd", "prev_dpd_2m", "prev_dpd_3m", "months_in_state")]
    d = df.select(
        *keep,
        F.coalesce(dpd - F.col("prev_dpd"), F.lit(0.0)).alias("dpd_delta"),
        F.coalesce(dpd - F.col("prev_dpd_2m"), F.lit(0.0)).alias("dpd_velocity_2m"),
        F.coalesce(dpd - F.col("prev_dpd_3m"), F.lit(0.0)).alias("dpd_velocity_3m"),
        dpd_band_position("risk_state", "days_in_arrears").alias("dpd_band_position"))
    d = d.select(
        "*",
        clip_lower(dpd + F.col("dpd_delta"), 0.0).alias("projected_dpd_next"),
        (F.col("dpd_delta") * 0.6 + F.col("dpd_velocity_2m") / 2.0 * 0.4).alias("smooth_velocity"))
    return d.select(
        "*", clip_lower(dpd + F.col("smooth_velocity"), 0.0).alias("smooth_proj_dpd")).select(
        "*", *dpd_flags(),
        (F.col("risk_state_code") > F.col("prev_risk_state_code")).cast("int").alias("transitioning_up"),
        (F.col("risk_state_code") < F.col("prev_risk_state_code")).cast("int").alias("transitioning_down"))


def dpd_flags(kind: str = "int") -> list:
    """The flags of a row's arrears and its two projections."""
    dpd, p, sp = F.col("days_in_arrears"), F.col("projected_dpd_next"), F.col("smooth_proj_dpd")
    flags = {
        "proj_will_be_high": between_flag(p, 31, 90), "proj_will_be_default": p > 90,
        "proj_will_be_medium": between_flag(p, 1, 30), "proj_will_be_low": p == 0,
        "smooth_proj_high": between_flag(sp, 31, 90), "smooth_proj_default": sp > 90,
        "near_high_threshold": between_flag(dpd, 22, 30), "near_default_threshold": between_flag(dpd, 75, 90),
        "near_medium_threshold": between_flag(dpd, 1, 8)}
    return [c.cast(kind).alias(name) for name, c in flags.items()]


def month_index(panel: DataFrame) -> DataFrame:
    """Ordinal of each distinct panel month and the previous existing month.
    Distinct months are few (one per calendar month), so this is a tiny table."""
    months = panel.select("observation_month").distinct()
    w = Window.orderBy("observation_month")
    return months.select("observation_month",
                         F.dense_rank().over(w).alias("month_idx"),
                         F.lag("observation_month", 1).over(w).alias("prev_month"))


def loan_age_ratio(df: DataFrame) -> DataFrame:
    """age/term clipped; falls back to instalments paid without an age column."""
    num = F.col("loan_age_months") if "loan_age_months" in df.columns \
        else F.col("number_instalments_paid")
    return df.withColumn("loan_age_ratio",
                         safe_ratio_clip(num.cast("double"), F.col("loan_term_months")))


def with_lifecycle_stage(df: DataFrame) -> DataFrame:
    """E12 (null ratio -> Late Stage)."""
    if "loan_age_ratio" not in df.columns:
        df = loan_age_ratio(df)
    return df.withColumn("lifecycle_stage", lifecycle_stage("loan_age_ratio"))


def remaining_months(df: DataFrame) -> DataFrame:
    """int(coalesce(max(term - age, 1), 12)); instalments paid as fallback."""
    if "loan_age_months" in df.columns:
        used = F.col("loan_age_months")
    elif "number_instalments_paid" in df.columns:
        used = F.col("number_instalments_paid")
    else:
        return df.withColumn("remaining_months", F.lit(12))
    rem = clip_lower(F.col("loan_term_months") - used, 1.0)
    return df.withColumn("remaining_months", F.coalesce(rem, F.lit(12.0)).cast("int"))


def payment_flags(df: DataFrame) -> DataFrame:
    """The colour band of each payment metric, named by the state whose
    colour it takes. Null metrics count as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dpd, inst, rr = z("days_in_arrears"), z("instalments_in_arrears"), z("repayment_ratio")
    return df.select(
        "*",
        F.when(dpd > 90, "Default").when(dpd > 30, "High").when(dpd > 0, "Medium")
         .otherwise("Low").alias("dpd_flag"),
        F.when(inst > 2, "High").when(inst > 0, "Medium").otherwise("Low").alias("instalment_flag"),
        F.when(rr > 0.8, "Low").when(rr > 0.5, "Medium").otherwise("High").alias("repayment_flag"),
        F.when(z("penal_interest") > 0, "High").otherwise("Low").alias("penal_flag"),
        F.when(z("suspended_interest") > 0, "Default").otherwise("Low").alias("suspended_flag"),
    )
