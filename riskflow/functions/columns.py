"""Scalar column expressions used across operators.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen. Null semantics follow the panel rule: NULL in, NULL out (pandas NaN).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.states import (DPD_HIGH_MAX, DPD_HIGH_MIN, DPD_MEDIUM_MAX,
                             DPD_MEDIUM_MIN, STATES)

__all__ = [
    "col_", "clip", "clip_lower", "clip_upper", "state_from_dpd", "parse_yyyymmdd",
    "parse_month", "month_diff", "urgency_label", "dpd_band_position", "between_flag",
    "safe_ratio_clip", "lifecycle_stage",
]


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Null-preserving clip (pandas ``clip``). ``greatest``/``least`` would turn
    a null into the bound, so this is a ``when`` chain instead."""
    c = col_(c)
    out = c
    if lo is not None and hi is not None:
        return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(c)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(c)
    return out


def clip_lower(c, lo):
    return clip(c, lo=lo)


def clip_upper(c, hi):
    return clip(c, hi=hi)


def state_from_dpd(dpd: Column | str, unknown: str | None = "Unknown") -> Column:
    """Band days-past-due into a state. Fractional gaps (30.5) fall in no band."""
    d = col_(dpd)
    return (F.when(d == 0, F.lit(STATES[0]))
            .when((d >= DPD_MEDIUM_MIN) & (d <= DPD_MEDIUM_MAX), F.lit(STATES[1]))
            .when((d >= DPD_HIGH_MIN) & (d <= DPD_HIGH_MAX), F.lit(STATES[2]))
            .when(d > DPD_HIGH_MAX, F.lit(STATES[3]))
            .otherwise(F.lit(unknown).cast("string")))


def parse_yyyymmdd(c: Column | str) -> Column:
    """First 8 characters as yyyyMMdd; malformed -> null (never throws). Eight digits
    and a day that every month has are read as numbers; a pattern or formatter per
    row, which settles all other texts, costs several times as much."""
    s = F.substring(F.col(c) if isinstance(c, str) else c.cast("string"), 1, 8)
    n = s.try_cast("int")
    month, day = (n / 100).cast("int") % 100, n % 100
    # a number from 10,000,000 in eight characters has no sign, blank or point among them
    usual = (F.length(s) == 8) & (n >= 10_000_000) & month.between(1, 12) & day.between(1, 28)
    iso = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2))
    return F.when(usual, F.make_date((n / 10_000).cast("int"), month, day)).otherwise(
        F.when(s.rlike(r"^[0-9]{8}\z"), F.try_to_date(iso)))


def parse_month(c: Column | str) -> Column:
    """``yyyy-MM`` -> first day of the month. The usual form is read as numbers."""
    s = col_(c)
    year, month, tens = F.substring(s, 1, 4).try_cast("int"), F.substring(s, 6, 2).try_cast("int"), F.substring(s, 6, 1)
    # as above: neither number can hold a sign, blank or point
    usual = ((F.length(s) == 7) & (F.substring(s, 5, 1) == "-") & (year >= 1000)
             & month.between(1, 12) & ((month >= 10) | (tens == "0")))
    day = F.concat(s, F.lit("-01"))
    return F.when(usual, F.make_date(year, month, F.lit(1))).otherwise(
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}\z"), F.try_to_date(day)).otherwise(F.try_to_date(day, "yyyy-MM-dd")))


def month_diff(later: Column, earlier: Column) -> Column:
    """Calendar month difference 12*dyear + dmonth (not months_between)."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def safe_ratio_clip(num: Column, den: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``den > 0 ? clip(num/den, lo, hi) : 0``. A null numerator stays null; a null
    denominator is not > 0 and gives 0, as in the reference."""
    return F.when(den > 0, clip(num / den, lo, hi)).otherwise(F.lit(0.0))


def between_flag(c: Column | str, lo: float, hi: float) -> Column:
    c = col_(c)
    return ((c >= lo) & (c <= hi)).cast("int")


def dpd_band_position(state: Column | str, dpd: Column | str) -> Column:
    """Position of DPD inside its state's band, clipped to [0, 1]."""
    s, d = col_(state), col_(dpd)
    raw = (F.when(s == STATES[0], d / 3.0)
           .when(s == STATES[1], clip(d - 5, lo=0.0) / 24.0)
           .when(s == STATES[2], clip(d - 31, lo=0.0) / 58.0)
           .when(s == STATES[3], clip(d / 280.0, hi=1.0))
           .otherwise(F.lit(0.0)))
    return clip(raw, 0.0, 1.0)


# Urgency bins are right-closed (0, .20], (.20, .50], (.50, .75], (.75, 1.01].
URGENCY_BINS = [(0.0, 0.20, "Low urgency"), (0.20, 0.50, "Medium urgency"),
                (0.50, 0.75, "High urgency"), (0.75, 1.01, "CRITICAL")]


def urgency_label(p: Column | str) -> Column:
    p = col_(p)
    expr = None
    for lo, hi, lab in URGENCY_BINS:
        cond = (p > lo) & (p <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


# Lifecycle stage cut points on loan_age_ratio.
STAGE_EARLY, STAGE_MID, STAGE_LATE = "Early Stage", "Mid Stage", "Late Stage"


def lifecycle_stage(ratio: Column | str) -> Column:
    """<0.33 Early, <0.66 Mid, else Late — a null ratio lands in Late."""
    r = col_(ratio)
    return (F.when(r < 0.33, F.lit(STAGE_EARLY)).when(r < 0.66, F.lit(STAGE_MID))
            .otherwise(F.lit(STAGE_LATE)))
