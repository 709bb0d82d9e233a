"""Neighbouring rows from bucket summaries equal the window over the whole loan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.operators import clean, features, sequence
from riskflow.sources.panel import panel_from_tpch
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"


def rows(df):
    return canon([tuple(r) for r in df.collect()], df.columns)


def by_window(df):
    """The same columns from one window per loan."""
    w = Window.partitionBy("loan_id").orderBy("observation_month", "row_seq")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.lag("s").over(w).isNull() | (F.lag("s").over(w) != F.col("s"))
    d = df.select("*", F.row_number().over(w).alias("rn"), turn.alias("turn"),
                  *[F.lag("x", k).over(w).alias(f"x{k}") for k in (1, 2, 3)], F.lead("s").over(w).alias("n"))
    streak = F.col("rn") - F.max(F.when(F.col("turn"), F.col("rn"))).over(run) + 1
    return d.select("loan_id", "observation_month", "row_seq", "s", "x", "x1", "x2", "x3", "n", streak.alias("run"))


def by_buckets(df):
    n = sequence.with_neighbours(df, {"s": "s", "x": "x"}, lags=3, lead=True, run_of="s")
    return n.select(*df.columns, *[F.col(f"_lag{k}.x").alias(f"x{k}") for k in (1, 2, 3)],
                    F.col("_next.s").alias("n"), F.col("_run").alias("run"))


@pytest.mark.parametrize("block", [1, 3, 50, 100_000])
@pytest.mark.parametrize("same", [0.5, 0.95])
def test_equals_the_window_on_copies_and_numeric_ids(spark, monkeypatch, block, same):
    monkeypatch.setattr(sequence, "BLOCK_ROWS", block)
    r, data, seq = random.Random(block), [], 0
    for loan, months, copies in [("000123", 6, 60), ("123", 5, 1), ("LN7", 1, 1), ("B", 3, 2), ("0", 9, 3)]:
        state = "Low"
        for m in range(months):
            for _ in range(r.randint(1, copies)):
                state = state if r.random() < same else r.choice(["Low", "Medium", "High"])
                data.append((loan, f"2024-{m + 1:02d}", seq, state, float(r.randint(0, 99))))
                seq += 1
    r.shuffle(data)
    df = spark.createDataFrame(data, "loan_id string, observation_month string, row_seq long, s string, x double")
    assert rows(by_buckets(df)) == rows(by_window(df))


def test_featured_panel_carries_the_next_state(spark):
    p = panel_from_tpch(spark, SF)
    one = features.trajectory_features(clean.verified_columns(p), with_next=True)
    two = features.trajectory_features(clean.verified_panel(p))
    assert set(one.columns) == set(two.columns)
    assert rows(one.select(*sorted(one.columns))) == rows(two.select(*sorted(two.columns)))


def test_a_loan_without_ingestion_order(spark):
    df = spark.createDataFrame([("A", f"2024-0{m}", s) for m, s in enumerate("xxyxx", 1)],
                               "loan_id string, observation_month string, s string")
    got = sequence.with_neighbours(df, {"s": "s"}, lead=True, run_of="s").orderBy("observation_month").collect()
    assert [r["_next"] and r["_next"].s for r in got] == ["x", "y", "x", "x", None]
    assert [r["_run"] for r in got] == [1, 2, 1, 1, 2]
