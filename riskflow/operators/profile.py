"""Profiling (P1-P7). Each is one aggregate pass (partial aggregation on the
map side), and the results are a handful of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panel_shape(panel: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, distinct months / loans / customers. ``approx`` switches to
    HyperLogLog sketches (bounded memory at any cardinality)."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return panel.agg(F.count(F.lit(1)).alias("n_rows"),
                     cd("observation_month").alias("n_months"),
                     cd("loan_id").alias("n_loans"),
                     cd("customer_id").alias("n_customers"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n_null)`` for columns with at least one null."""
    cols = columns or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "n_null")
    return long.filter(F.col("n_null") > 0)


def total_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or df.columns
    s = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    return df.agg(s.alias("total_nulls"))


def value_distribution(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Count and percent of total per value. The total is a
    scalar over the same groups (their exchange is reused); no step gathers
    the groups into one task."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_tot")).scalar()
    return g.select(col, "count", F.round(F.col("count") * 100.0 / total, digits).alias("pct"))


def describe(df: DataFrame, col: str, digits: int = 1, approx: bool = False) -> DataFrame:
    """count/mean/std/min/25/50/75%/max (pandas ``describe``: sample std,
    linear-interpolation quartiles). Exact ``percentile`` keeps one counter per
    distinct value; ``approx=True`` uses a bounded-size sketch instead."""
    c = F.col(col).cast("double")
    if approx:
        q = [F.percentile_approx(c, p, 10000) for p in (0.25, 0.5, 0.75)]
    else:
        q = [F.percentile(c, F.lit(p)) for p in (0.25, 0.5, 0.75)]
    r = lambda e: F.round(e, digits)
    return df.agg(F.count(c).cast("double").alias("count"), r(F.avg(c)).alias("mean"),
                  r(F.stddev_samp(c)).alias("std"), r(F.min(c)).alias("min"),
                  r(q[0]).alias("p25"), r(q[1]).alias("p50"), r(q[2]).alias("p75"),
                  r(F.max(c)).alias("max"))


def remaining_buckets(df: DataFrame, col: str = "remaining_months") -> DataFrame:
    """P5: overlapping counts <= 3, <= 6 and > 24."""
    c = F.col(col)
    return df.agg(F.count_if(c <= 3).alias("le_3"), F.count_if(c <= 6).alias("le_6"),
                  F.count_if(c > 24).alias("gt_24"))


def segment_coverage(panel: DataFrame, key: str = "loan_id",
                     order=("row_seq", "observation_month")) -> DataFrame:
    """Segment of each loan's first row (ingestion order), counted; a
    null segment is not counted. ``min_by`` on a struct of the order columns
    picks the first row inside the aggregate (partial aggregation, no sort)."""
    first = panel.groupBy(key).agg(
        F.min_by("segment", F.struct(*[F.col(o) for o in order if o in panel.columns]))
        .alias("segment"))
    return first.filter(F.col("segment").isNotNull()) \
        .groupBy("segment").agg(F.count(F.lit(1)).alias("n_loans"))


def class_balance(df: DataFrame, label: str = "next_risk_state") -> DataFrame:
    """Rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
