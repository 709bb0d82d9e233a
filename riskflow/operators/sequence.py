"""Values of neighbouring rows of a loan without gathering the loan.

A loan may hold any number of rows (duplicate copies are kept), so a window
over the whole loan could put most of a panel into one task. Rows are instead
windowed inside buckets of (loan, month, ``BLOCK_ROWS`` of ingestion order); one
summary row per bucket goes through a window over the loan, and what it carries
in - the last rows before the bucket, the first row after it, the length of the
run that reaches it - joins the bucket's rows. A loan's summary has one row per
month and block. The result equals the window over the whole loan.

The buckets cost a second read of the input and a join. Where the caller knows
that a loan's rows fit a task (``bounded``: the adapter's panel has one row per
loan, month and row of ``part``, and its own walk gathers a loan's months), the
columns come from that window itself: one exchange and one sort by loan, which
the adapter's walk has made already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.schema import ROW_SEQ

BLOCK_ROWS = 100_000


def with_neighbours(df: DataFrame, payload: dict[str, Column | str], lags: int = 0, lead: bool = False,
                    run_of: str | None = None, key: str = "loan_id",
                    order=("observation_month", ROW_SEQ), bounded: bool = False) -> DataFrame:
    """Adds ``_lag1.._lagN`` and ``_next`` (structs of ``payload``, null past the
    loan's ends) and ``_run``: rows since the payload field ``run_of`` last
    changed, counted from 1. Ties of the order are broken arbitrarily, as in a
    window. Without the ingestion order a bucket is a loan's month."""
    month, seq = order[0], (order[1] if len(order) > 1 and order[1] in df.columns else None)
    block = F.floor(F.col(seq) / BLOCK_ROWS) if seq else F.lit(0).cast("bigint")
    me = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in payload.items()])
    if bounded:
        return _by_loan(df, payload, lags, lead, run_of, key, [month, seq] if seq else [month])
    rows = df.withColumn("_me", me).withColumn("_blk", block)
    bucket = Window.partitionBy(key, month, "_blk").orderBy(F.col(seq) if seq else F.lit(0))
    so_far = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [F.row_number().over(bucket).alias("_r"), F.lead("_me").over(bucket).alias("_after"),
            F.first("_me").over(so_far).alias("_first")]
    cols += [F.lag("_me", k).over(bucket).alias(f"_p{k}") for k in range(1, max(lags, 1) + 1)]
    rows = rows.select("*", *cols)
    if run_of:
        changed = (F.col("_r") > 1) & ~F.col("_p1")[run_of].eqNullSafe(F.col("_me")[run_of])
        rows = rows.withColumn("_turn", F.max(F.when(changed, F.col("_r"))).over(so_far))
    else:
        rows = rows.withColumn("_turn", F.lit(None).cast("int"))

    # one row per bucket: its last row knows everything the neighbours need
    last = rows.where(F.col("_after").isNull()).select(
        F.col(key).alias("_k"), F.col(month).alias("_m"), F.col("_blk").alias("_b"), "_first", "_me",
        F.col("_r").alias("_n"), (F.col("_r") - F.col("_turn") + 1).alias("_tail"),
        F.filter(F.array("_me", *[f"_p{k}" for k in range(1, lags)]), lambda x: x.isNotNull()).alias("_end"))
    loan = Window.partitionBy("_k").orderBy("_m", "_b")
    upto = loan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nothing = F.array().cast(last.schema["_end"].dataType)
    before = F.concat(*[F.coalesce(F.lag("_end", k).over(loan), nothing) for k in range(1, max(lags, 1) + 1)])
    s = last.select("*", F.slice(before, 1, max(lags, 1)).alias("_before"), F.lead("_first").over(loan).alias("_then"))
    if run_of:
        joins = F.coalesce(F.lag("_me").over(loan)[run_of].eqNullSafe(F.col("_first")[run_of])
                           & F.lag("_n").over(loan).isNotNull(), F.lit(False))
        s = s.withColumn("_joins", joins)
        s = s.withColumn("_adds", F.coalesce("_tail", "_n"))
        s = s.withColumn("_sum", F.sum("_adds").over(upto))
        starts = F.col("_tail").isNotNull() | ~F.col("_joins")
        s = s.withColumn("_base", F.last(F.when(starts, F.col("_sum") - F.col("_adds")), ignorenulls=True).over(upto))
        s = s.withColumn("_carry", F.when(F.col("_joins"), F.lag(F.col("_sum") - F.col("_base")).over(loan)).otherwise(0))
    else:
        s = s.withColumn("_carry", F.lit(0))
    s = s.select(F.col("_k"), F.col("_m"), F.col("_b"), "_before", "_then", "_carry")

    j = rows.join(s, (rows[key] == s["_k"]) & (rows[month] == s["_m"]) & (rows["_blk"] == s["_b"]), "left")
    out = [F.coalesce(F.col(f"_p{k}"), F.when(F.col("_r") <= k, F.get("_before", F.lit(k) - F.col("_r")))).alias(f"_lag{k}")
           for k in range(1, lags + 1)]
    if lead:
        out.append(F.coalesce("_after", "_then").alias("_next"))
    if run_of:
        out.append(F.coalesce(F.col("_r") - F.col("_turn") + 1, F.col("_r") + F.coalesce("_carry", F.lit(0)))
                   .cast("int").alias("_run"))
    return j.select(*df.columns, *out)


def _own(payload: dict) -> dict[str, str]:
    """The column that holds a payload field of the row itself."""
    return {n: c if isinstance(c, str) else f"_me_{n}" for n, c in payload.items()}


def loan_neighbours(df: DataFrame, payload: dict[str, Column | str], lags: int = 0, lead: bool = False,
                    run_of: str | None = None, key: str = "loan_id",
                    order=("observation_month", ROW_SEQ)) -> DataFrame:
    """:func:`with_neighbours` for loans that fit a task, as plain columns:
    ``_lag1_<field>``.., ``_next_<field>``, ``_has_next``, ``_r`` (the row's number in its
    loan) and ``_run``. Windows over plain values cost a fraction of those over structs,
    and what no reader names is not computed."""
    loan = Window.partitionBy(key).orderBy(*[c for c in order if c in df.columns])
    me = _own(payload)
    rows = df.select("*", *[c.alias(me[n]) for n, c in payload.items() if not isinstance(c, str)])
    cols = [F.row_number().over(loan).alias("_r")]
    for k in range(1, max(lags, 1 if run_of else 0) + 1):
        cols += [F.lag(me[n], k).over(loan).alias(f"_lag{k}_{n}") for n in payload]
    if lead:
        cols += [F.lead(me[n]).over(loan).alias(f"_next_{n}") for n in payload]
        cols += [F.coalesce(F.lead(F.lit(True)).over(loan), F.lit(False)).alias("_has_next")]
    rows = rows.select("*", *cols)
    if run_of:
        so_far = loan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = (F.col("_r") == 1) | ~F.col(f"_lag1_{run_of}").eqNullSafe(F.col(me[run_of]))
        rows = rows.withColumn("_turn", F.max(F.when(starts, F.col("_r"))).over(so_far)) \
                   .withColumn("_run", (F.col("_r") - F.col("_turn") + 1).cast("int")).drop("_turn")
    return rows


def neighbours_of_copies(df: DataFrame, payload: dict[str, Column | str], lags: int = 0, lead: bool = False, run_of: str | None = None,
                         copy: str = "_copy", copies: str = "_copies") -> DataFrame:
    """The columns of :func:`loan_neighbours` where a join has since made ``copies`` rows
    of every row of a loan, as a window over the loan's joined rows would give them:
    row ``copy`` (from 0) of a month follows the one before it, and the first of a
    month the last of the month before."""
    j, m = F.col(copy), F.col(copies)
    out = {}
    for f, me in _own(payload).items():
        for k in range(1, lags + 1):
            back = F.when(j >= k, F.col(me))
            for i in range(1, k):
                back = back.when(j + m * i >= k, F.col(f"_lag{i}_{f}"))
            out[f"_lag{k}_{f}"] = back.otherwise(F.col(f"_lag{k}_{f}"))
        if lead:
            out[f"_next_{f}"] = F.when(j + 1 < m, F.col(me)).otherwise(F.col(f"_next_{f}"))
    if lead:
        out["_has_next"] = F.col("_has_next") | (j + 1 < m)
    if run_of:
        out["_run"] = ((F.col("_run") - 1) * m + j + 1).cast("int")
    out["_r"] = ((F.col("_r") - 1) * m + j + 1).cast("int")
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns if c not in (copy, copies)])


def as_structs(rows: DataFrame, payload, lags: int = 0, lead: bool = False) -> DataFrame:
    """``_lag1``.. and ``_next`` of :func:`with_neighbours` from the plain columns."""
    def me(kind):
        return F.struct(*[F.col(f"{kind}_{n}").alias(n) for n in payload])
    out = [F.when(F.col("_r") > k, me(f"_lag{k}")).alias(f"_lag{k}") for k in range(1, lags + 1)]
    if lead:
        out.append(F.when(F.col("_has_next"), me("_next")).alias("_next"))
    return rows.select("*", *out)


def _by_loan(df: DataFrame, payload: dict, lags: int, lead: bool, run_of: str | None, key: str, order: list[str]) -> DataFrame:
    """The columns of :func:`with_neighbours` from one window per loan."""
    rows = as_structs(loan_neighbours(df, payload, lags, lead, run_of, key, order), payload, lags, lead)
    return rows.select(*df.columns, *[f"_lag{k}" for k in range(1, lags + 1)], *(["_next"] if lead else []),
                       *(["_run"] if run_of else []))
