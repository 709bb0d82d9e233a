"""Watchlists: filters (WF1-WF14), ranking and paging (T1-T3), prediction
summaries (A14), the within-term early-warning list (nb03b: F7, F8, E13-E14,
A12, A13) and display columns (E18-E20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import urgency_label
from riskflow.states import STATES

# Page sizes.
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100


def _c(name):
    return F.col(name)


# The business rules of the filters.
def watch_filters() -> dict[str, Column]:
    """Filter name -> predicate over ``risk_state, pred, p_default, is_worse``."""
    s, p, pd_, worse = _c("risk_state"), _c("pred"), _c("p_default"), _c("is_worse")
    return {
        "about_to_default": (s == "High") & (pd_ >= 0.25),
        "high_risk_any": s == "High",
        "high_to_high": (s == "High") & (p == "High") & (pd_ >= 0.10),
        "medium_to_high": (s == "Medium") & (p == "High"),
        "medium_elevated": (s == "Medium") & (pd_ >= 0.10),
        "medium_to_default": (s == "Medium") & (p == "Default"),
        "low_to_medium": (s == "Low") & (p == "Medium"),
        "low_to_high": (s == "Low") & p.isin("High", "Default"),
        "fast_deterioration": (s != "Default") & p.isin("High", "Default"),
        "all_deteriorating": (s != "Default") & worse,
        "all_performing": s != "Default",
        "legacy_about_to_default": (s == "High") & (p == "Default"),
        "legacy_high_to_high": (s == "High") & (p == "High"),
        "legacy_early_warning": (s == "Low") & worse,
    }


def watch_filter(scored: DataFrame, filter_type: str) -> DataFrame:
    """Apply one filter; an unknown name falls through to ``all_performing``."""
    f = watch_filters()
    return scored.filter(f.get(filter_type, f["all_performing"]))


def rank_watchlist(df: DataFrame, score: str = "score") -> DataFrame:
    """Score descending, loan_id as a deterministic tie-break."""
    return df.orderBy(F.col(score).desc(), F.col("loan_id").asc())


def paginate(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
             score: str = "score") -> DataFrame:
    """One page of the ranked list with ``total`` and ``total_pages``.

    The page is a top-(offset+size) (TakeOrderedAndProject: per-partition
    top-k, then a k-row merge); the total is a scalar. A page past the end has
    no rows; :func:`page_info` has the totals then too.
    """
    size = max(1, min(int(page_size), MAX_PAGE_SIZE))
    page = max(1, int(page))
    rows = rank_watchlist(df, score).offset((page - 1) * size).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.withColumn("total", total).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint"))


def page_info(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row with ``total, total_pages, page, page_size``, also for an empty
    list or a page past its end."""
    size, page = max(1, min(int(page_size), MAX_PAGE_SIZE)), max(1, int(page))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint").alias("total_pages"),
        F.lit(page).alias("page"), F.lit(size).alias("page_size"))


def watchlist(scored: DataFrame, filter_type: str = "all_deteriorating", page: int = 1,
              page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """WF* -> T1 -> T2 with the record projection (probabilities 4 dp). The
    projection comes before paging: column pruning does not cross ``offset``,
    so this keeps the scan to the record's columns."""
    f = watch_filter(scored, filter_type).select(
        "loan_id", "customer_id", "segment", "risk_state", "pred",
        F.col("days_in_arrears").cast("int").alias("days_in_arrears"),
        F.col("instalments_in_arrears").cast("int").alias("instalments_in_arrears"),
        "principal_balance",
        F.round("p_default", 4).alias("p_default"), F.round("p_high", 4).alias("p_high"),
        F.round("p_pred", 4).alias("p_pred"), F.col("score").alias("_score"),
        F.round("score", 4).alias("score"), "is_worse")
    p = paginate(f, page, page_size, score="_score")
    return p.drop("_score")


def prediction_summary(scored: DataFrame, by: list[str] | None = None,
                       states: list[str] = STATES, pred_col: str = "pred") -> DataFrame:
    """Predicted-state counts, zero-filled (one aggregate, no pivot job)."""
    by = list(by or [])
    return scored.groupBy(*by).agg(*[F.count_if(F.col(pred_col) == s).alias(s) for s in states])


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """head(n) of an ordering (a top-k report)."""
    return df.orderBy(*order).limit(n)


def combined_score(df: DataFrame, horizon_col: str = "horizon_risk") -> DataFrame:
    """0.6 * score + 0.4 * horizon risk, transition label, percent text."""
    return (df.withColumn("combined_score", F.col("score") * 0.6 + F.col(horizon_col) * 0.4)
              .withColumn("transition_label", F.concat(F.col("risk_state"), F.lit(" → "), F.col("pred")))
              .withColumn("horizon_risk_text", F.format_string("%.1f%%", F.col(horizon_col) * 100.0)))


# ---------------------------------------------------------------------------
# Within-term early warning (remaining-term adjustment)
# ---------------------------------------------------------------------------

WATCH_COLUMNS = ["loan_id", "customer_id", "risk_state", "segment", "days_in_arrears",
                 "instalments_in_arrears", "remaining_months", "within_term_default_prob"]


def with_urgency(df: DataFrame, prob: str = "within_term_default_prob") -> DataFrame:
    return df.withColumn("urgency", urgency_label(prob))


def risk_watch_subset(df: DataFrame) -> DataFrame:
    """F8: Medium and High accounts, 8-column projection, with urgency."""
    d = df.filter(F.col("risk_state").isin("Medium", "High")).select(*WATCH_COLUMNS)
    return with_urgency(d)


def critical_accounts(df: DataFrame, max_remaining: int = 6) -> DataFrame:
    """High with <= 6 months remaining, most probable first; when there
    are none, every High account. The fallback is decided inside the plan
    (a scalar count), not on the driver."""
    high = df.filter(F.col("risk_state") == "High")
    near = high.agg(F.count_if(F.col("remaining_months") <= max_remaining).alias("_n")).scalar()
    j = high.withColumn("_n", near)
    keep = (F.col("_n") == 0) | (F.col("remaining_months") <= max_remaining)
    return j.filter(keep).drop("_n").select(
        "loan_id", "customer_id", "risk_state", "days_in_arrears", "remaining_months",
        "within_term_default_prob")


def prob_by_state(df: DataFrame, prob: str = "within_term_default_prob",
                  digits: int = 6) -> DataFrame:
    """Mean / min / max of the within-term probability per state."""
    p = F.col(prob)
    return df.groupBy("risk_state").agg(F.round(F.avg(p), digits).alias("mean_prob"),
                                        F.round(F.min(p), digits).alias("min_prob"),
                                        F.round(F.max(p), digits).alias("max_prob"))


def urgency_breakdown(watch: DataFrame) -> DataFrame:
    """A13."""
    return watch.groupBy("urgency").agg(F.count(F.lit(1)).alias("n"))
