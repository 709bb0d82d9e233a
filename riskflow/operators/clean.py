"""Cleaning (C1-C8) and the verified panel (nb01 features + next state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import (clip, clip_lower, month_diff, parse_month,
                                        parse_yyyymmdd, safe_ratio_clip, state_from_dpd)
from riskflow.operators.sequence import with_neighbours
from riskflow.schema import CRITICAL_COLUMNS, FILL_UNKNOWN, FILL_ZERO, ROW_SEQ
from riskflow.states import STATES, state_code


def drop_critical_nulls(panel: DataFrame, critical: list[str] = CRITICAL_COLUMNS) -> DataFrame:
    return panel.dropna(subset=critical)


def removed_count(panel: DataFrame, critical: list[str] = CRITICAL_COLUMNS) -> DataFrame:
    """before / after / removed row counts of C1, in one aggregate pass."""
    any_null = F.lit(False)
    for c in critical:
        any_null = any_null | F.col(c).isNull()
    return panel.agg(F.count(F.lit(1)).alias("before"),
                     F.count_if(~any_null).alias("after"),
                     F.count_if(any_null).alias("removed"))


def fill_noncritical(panel: DataFrame) -> DataFrame:
    fills = {c: "UNKNOWN" for c in FILL_UNKNOWN if c in panel.columns}
    fills.update({c: 0.0 for c in FILL_ZERO if c in panel.columns})
    return panel.fillna(fills)


def clean_panel(panel: DataFrame) -> DataFrame:
    """C1 + C2."""
    return fill_noncritical(drop_critical_nulls(panel))


def encode_state(df: DataFrame, col: str = "risk_state", out: str = "risk_state_code",
                 states: list[str] = STATES) -> DataFrame:
    return df.withColumn(out, state_code(col, states))


def with_state_from_dpd(df: DataFrame, dpd: str = "days_in_arrears", out: str = "dpd_state") -> DataFrame:
    return df.withColumn(out, state_from_dpd(dpd))


def fill_features(df: DataFrame, features: list[str]) -> DataFrame:
    """A missing feature column becomes 0, a null feature value becomes 0."""
    for f in features:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(0.0))
    return df.fillna(0, subset=features)


def verified_columns(panel: DataFrame, dropped: bool = False) -> DataFrame:
    """Cleaned panel + the row-wise nb01 features (no window). ``dropped``: the
    rows that C1 drops are gone already."""
    df = fill_noncritical(panel) if dropped else clean_panel(panel)
    if ROW_SEQ not in df.columns:
        df = df.withColumn(ROW_SEQ, F.lit(0).cast("bigint"))
    disb = F.col("disbursed_amount_lcy")
    # the dates are read once, in a step of their own: the age names each of them several times
    obs, dd = F.col("obs_date"), F.col("disbursement_date")
    df = df.select(*[c for c in df.columns if c not in ("disbursement_date", "obs_date")],
                   parse_yyyymmdd("disbursement_date").alias("disbursement_date"),
                   parse_month("observation_month").alias("obs_date"))
    return df.select(
        *[c for c in df.columns if c not in ("disbursement_date", "obs_date")],
        dd,
        state_code("risk_state").alias("risk_state_code"),
        F.when(disb > 0, clip(F.lit(1.0) - F.col("principal_balance") / disb, 0.0, 1.0))
         .otherwise(F.lit(0.0)).alias("repayment_ratio"),
        obs,
        clip_lower(month_diff(obs, dd), 0).cast("int").alias("loan_age_months"),
        safe_ratio_clip(F.col("instalments_in_arrears"), F.col("loan_term_months"))
        .alias("arrears_ratio"),
    )


def verified_panel(panel: DataFrame, key: str = "loan_id",
                   order=("observation_month", ROW_SEQ), bounded: bool = False) -> DataFrame:
    """Cleaned panel + risk_state_code, repayment_ratio, obs_date,
    loan_age_months, arrears_ratio, next_risk_state(_code)."""
    df = verified_columns(panel)
    n = with_neighbours(df, {"state": "risk_state", "code": "risk_state_code"}, lead=True, key=key, order=order,
                        bounded=bounded)
    return with_next_state(n, df.columns)


def with_next_state(neighbours: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the next state (W1) from the rows' ``_next``."""
    return neighbours.select(*columns, F.col("_next.state").alias("next_risk_state"),
                             F.col("_next.code").alias("next_risk_state_code"))


def transition_pairs(verified: DataFrame) -> DataFrame:
    """Rows that have a next state (the saved transitions table)."""
    return verified.filter(F.col("next_risk_state").isNotNull())
