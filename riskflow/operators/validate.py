"""Data-rule validation (V1-V12). All row rules are evaluated in ONE
aggregate pass and unpivoted into a ``(rule, violations, status)`` report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.schema import CRITICAL_COLUMNS

# Rule thresholds.
RATE_MIN, RATE_MAX = 0, 50
TERM_MIN, TERM_MAX = 1, 360


def rule_predicates(suspended_dpd: float = 90, strict_suspended: bool = False,
                    term_nulls_violate: bool = False) -> list[tuple[str, F.Column]]:
    """Each rule as (name, violation predicate). V5a flags DPD < 90, the
    stricter V5b (``strict_suspended``) flags DPD <= 90; V9 either ignores or
    counts a null term."""
    d = F.col("days_in_arrears")
    s = F.col("risk_state")
    susp = F.col("suspended_interest")
    term = F.col("loan_term_months")
    rate = F.col("interest_rate")
    susp_bad = (susp > 0) & ((d <= suspended_dpd) if strict_suspended else (d < suspended_dpd))
    term_ok = term.between(TERM_MIN, TERM_MAX)
    term_bad = ~F.coalesce(term_ok, F.lit(False)) if term_nulls_violate else ~term_ok
    return [
        ("V1_dpd0_is_low", (d == 0) & (s != "Low")),
        ("V2_dpd1_30_is_medium", (d >= 1) & (d <= 30) & (s != "Medium")),
        ("V3_dpd31_90_is_high", (d >= 31) & (d <= 90) & (s != "High")),
        ("V4_dpd_gt90_is_default", (d > 90) & (s != "Default")),
        ("V5_suspended_only_in_default", susp_bad),
        ("V7_negative_dpd", d < 0),
        ("V8_interest_rate_out_of_range", (rate < RATE_MIN) | (rate > RATE_MAX)),
        ("V8b_interest_rate_scale", rate > RATE_MAX),
        ("V9_term_out_of_range", term_bad),
    ]


def rule_report(panel: DataFrame, key=("loan_id", "observation_month"),
                strict_suspended: bool = False, term_nulls_violate: bool = False,
                critical: list[str] = CRITICAL_COLUMNS) -> DataFrame:
    """V1-V12 in one pass, unpivoted to ``(rule, violations, status)``: partial
    counts per (loan, month), then their sums. V6 (duplicates after the first)
    is the rows of each key beyond one.
    """
    preds = rule_predicates(strict_suspended=strict_suspended,
                            term_nulls_violate=term_nulls_violate)
    any_null = F.lit(False)
    for c in critical:
        any_null = any_null | F.col(c).isNull()
    preds = [*preds, ("V11_critical_nulls", any_null)]
    by_key = panel.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(p).alias(n) for n, p in preds])
    zero = F.lit(0).cast("bigint")
    j = by_key.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n, _ in preds],
                   F.coalesce(F.sum(F.col("_n") - 1), zero).alias("V6_duplicate_rows"))
    names = [c for c in j.columns]
    long = j.unpivot([], names, "rule", "violations")
    status = F.when(F.col("violations") == 0, F.lit("PASS")) \
        .otherwise(F.concat(F.lit("FLAG — "), F.format_number(F.col("violations"), 0), F.lit(" records")))
    return long.select("rule", F.col("violations").cast("bigint").alias("violations"),
                       status.alias("status"))


def overall_verdict(report: DataFrame) -> DataFrame:
    """V12 verdict: PASSED when no rule flags, else FLAGS (review first)."""
    n = F.count_if(F.col("violations") > 0)
    return report.agg(n.alias("n_flagged"),
                      F.when(n == 0, F.lit("PASSED")).otherwise(F.lit("FLAGS")).alias("verdict"))


def duplicate_rows(df: DataFrame, key=("loan_id", "observation_month")) -> DataFrame:
    """V6 alone: rows beyond the first per key."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def panel_continuity(panel: DataFrame, key: str = "loan_id") -> DataFrame:
    """Loans observed in every panel month vs fewer. One pass to the
    distinct (loan, month) pairs; months per loan and the panel's month count
    (a scalar) both come from them."""
    seen = panel.select(key, "observation_month").where(F.col("observation_month").isNotNull()).distinct()
    months = seen.agg(F.countDistinct("observation_month").alias("_all")).scalar()
    # loans without any month have none of the panel's months
    per_loan = panel.groupBy(key).agg(F.lit(0).alias("_z")).join(
        seen.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_m")),
        F.col(key).eqNullSafe(F.col("_k")), "left").select(F.coalesce("_m", F.lit(0)).alias("_m"))
    return per_loan.withColumn("_all", months).agg(
        F.first("_all").alias("n_months"),
        F.count_if(F.col("_m") == F.col("_all")).alias("complete_loans"),
        F.count_if(F.col("_m") < F.col("_all")).alias("incomplete_loans"))
