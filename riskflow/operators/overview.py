"""Snapshots, month/segment lists, portfolio and trend aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.states import STATES

ALL_SEGMENTS = "All Segments"


def snapshot(panel: DataFrame, month: str | None, segment: str | None = ALL_SEGMENTS) -> DataFrame:
    """one month (and optionally one segment). A blank month is empty.
    On a month-partitioned panel the month filter prunes partitions."""
    if month is None or str(month).strip() == "":
        return panel.filter(F.lit(False))
    d = panel.filter(F.col("observation_month") == month)
    if segment not in (None, ALL_SEGMENTS):
        d = d.filter(F.col("segment") == segment)
    return d


def latest_month(panel: DataFrame) -> DataFrame:
    return panel.agg(F.max("observation_month").alias("_latest"))


def latest_snapshot(panel: DataFrame) -> DataFrame:
    """rows of the latest month, filtered by a scalar subquery. On a
    month-partitioned table the subquery reads only partition values and the
    filter prunes to one partition at run time."""
    return panel.filter(F.col("observation_month") == latest_month(panel).scalar())


def list_months(panel: DataFrame) -> DataFrame:
    """distinct months, ascending (a tiny result: one row per month)."""
    return panel.select("observation_month").distinct().orderBy("observation_month")


def list_segments(panel: DataFrame) -> DataFrame:
    """``All Segments`` first, then the sorted segments other than UNKNOWN."""
    segs = (panel.select("segment").distinct()
                 .filter(F.col("segment").isNotNull() & (F.col("segment") != "UNKNOWN"))
                 .select(F.lit(1).alias("_o"), "segment"))
    head = panel.sparkSession.range(1).select(F.lit(0).alias("_o"), F.lit(ALL_SEGMENTS).alias("segment"))
    u = head.unionByName(segs)
    return u.orderBy("_o", "segment").drop("_o")


def _state_counts(df: DataFrame, states, col="risk_state"):
    return [F.count_if(F.col(col) == s).alias(s) for s in states]


def portfolio_snapshot(panel: DataFrame, month: str | None, segment: str | None = ALL_SEGMENTS,
                       states: list[str] = STATES) -> DataFrame:
    """A1: total, zero-filled count and percent (1 dp; 0 when empty) per state."""
    d = snapshot(panel, month, segment)
    agg = d.agg(F.count(F.lit(1)).alias("total"), *_state_counts(d, states))
    stack = ", ".join(f"'{s}', `{s}`" for s in states)
    long = agg.selectExpr("total", f"stack({len(states)}, {stack}) AS (state, count)")
    pct = F.when(F.col("total") > 0, F.round(F.col("count") * 100.0 / F.col("total"), 1)) \
        .otherwise(F.lit(0.0))
    return long.select(F.lit(month or "").alias("month"), "state", "count", "total",
                       pct.alias("pct"))


def risk_trend(panel: DataFrame, states: list[str] = STATES) -> DataFrame:
    """A2: month x state counts, zero-filled, months ascending (one pass)."""
    return panel.groupBy("observation_month").agg(*_state_counts(panel, states)) \
                .orderBy("observation_month")


def risk_trend_pct(panel: DataFrame, states: list[str] = STATES, digits: int = 4) -> DataFrame:
    """A3: each month's share of every state, x100."""
    t = risk_trend(panel, states)
    tot = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return t.select("observation_month",
                    *[F.round(F.col(s) * 100.0 / tot, digits).alias(s) for s in states])


def trend_tail(panel: DataFrame, k: int = 8, states: list[str] = STATES) -> DataFrame:
    """A4: the last ``k`` months (newest first) with a row total — a top-k
    report over one row per month."""
    t = panel.groupBy("observation_month").agg(*_state_counts(panel, states))
    tot = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return t.withColumn("total", tot).orderBy(F.col("observation_month").desc()).limit(k)
