"""One pass over a loan's rows, and one read of the input, for panels whose loans fit a task."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from riskflow.operators import sequence
from riskflow.plans import queries
from riskflow.sources.panel import panel_from_tpch
from tools.oracle_check import canon


@pytest.fixture()
def tables(spark, tmp_path):
    r = random.Random(3)
    lines = [(k, datetime.date(1996 + m // 12, m % 12 + 1, 5), r.choice("RNA"), float(r.randint(1, 50)))
             for k in (1, 2, 23, 24, 101, 202) for m in sorted(r.sample(range(30), 12)) for _ in range(r.randint(1, 3))]
    spark.createDataFrame(lines, "l_partkey long, l_shipdate date, l_returnflag string, l_quantity double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, f"Brand#{k}", "T", int(k), 900.0 + k) for k in (1, 2, 23, 24, 101, 202, 2)]    # a part twice
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def scans(df):
    return len(re.findall(r"Relation ?\[[^\]]*l_partkey", df._jdf.queryExecution().optimizedPlan().toString()))


def test_panel_queries_read_lineitem_once(spark, tables):
    for name in ("trajectory_features", "verified_panel", "account_latest_rows"):
        assert scans(queries.QUERIES[name](spark, tables)) == 1, name


def test_snapshot_queries_read_the_written_panel(spark, tables):
    for name in ("scored_snapshot", "critical_accounts", "watch_term_all_performing", "model_transition_matrix"):
        assert scans(queries.QUERIES[name](spark, tables)) == 0, name


def test_generated_methods_stay_compiled(spark, tables):
    queries.pf(spark, tables + "/")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("copies", [1, 4])
def test_one_window_equals_the_buckets(spark, copies):
    r, data, seq = random.Random(copies), [], 0
    for loan, months in [("A", 7), ("B", 1), ("C", 12), ("000123", 4), ("123", 4)]:
        for m in range(months):
            for _ in range(r.randint(1, copies)):
                data.append((loan, f"2024-{m + 1:02d}", seq, r.choice(["Low", "Low", "High", None]), float(r.randint(0, 9))))
                seq += 1
    r.shuffle(data)
    df = spark.createDataFrame(data, "loan_id string, observation_month string, row_seq long, s string, x double")
    one, two = (sequence.with_neighbours(df, {"s": "s", "x": "x"}, lags=3, lead=True, run_of="s", bounded=b) for b in (True, False))
    assert one.columns == two.columns
    assert canon([tuple(x) for x in one.collect()], one.columns) == canon([tuple(x) for x in two.collect()], two.columns)


def test_disbursement_lies_k_mod_24_months_back(spark, tables):
    p = panel_from_tpch(spark, tables)
    k = F.substring("loan_id", 3, 9).cast("int")
    first = p.groupBy("loan_id").agg(F.min("observation_month").alias("m"), F.min("disbursement_date").alias("d"),
                                     F.max("disbursement_date").alias("e"))
    want = F.when(k % 101 == 0, "2024131x").otherwise(
        F.date_format(F.add_months(F.to_date(F.concat("m", F.lit("-01"))), -(k % 24)), "yyyyMMdd"))
    rows = first.select("loan_id", "d", "e", want.alias("w")).collect()
    assert len(rows) == 6 and all(x.d == x.e == x.w for x in rows)


def test_windows_run_on_narrow_rows(spark):
    """Neighbours are found before the panel's columns are formed, and the written
    table holds the narrow rows; results equal the operators over the whole panel."""
    import re

    from riskflow.operators import clean, features
    from riskflow.plans.pipeline import Portfolio
    p = Portfolio(spark, "/root/testdata/sf0.001")
    wide = features.trajectory_features(clean.verified_columns(p.panel), with_next=True, bounded=True)
    written = p.written_features()
    assert wide.columns == p.featured.columns == written.columns
    assert wide.exceptAll(p.featured).count() == p.featured.exceptAll(wide).count() == 0
    assert wide.exceptAll(written).count() == written.exceptAll(wide).count() == 0
    verified = clean.verified_panel(p.panel, bounded=True)
    assert verified.columns == p.verified.columns
    assert verified.exceptAll(p.verified).count() == p.verified.exceptAll(verified).count() == 0
    plan = p.featured._jdf.queryExecution().optimizedPlan().toString()
    first_window = plan.index("Window [")
    assert plan.index("accrued_interest") < first_window                # formed above the windows
    assert "accrued_interest" not in re.split(r"Window \[", plan, maxsplit=1)[1]


def test_dates_are_read_by_cast(spark):
    from pyspark.sql import functions as F

    from riskflow.functions.columns import parse_month, parse_yyyymmdd
    rows = [("20010203", "2001-02"), ("2024131x", "2001-2"), ("20010229", "2001-13"), ("2001011 ", "+2001-01"), ("00000101", "0000-01"),
            ("2001-1-1", "2001-01-01"), ("2001010112", " 001-01"), (None, None)]
    df = spark.createDataFrame(rows, "d string, m string").select(
        "d", "m", parse_yyyymmdd("d").cast("string").alias("a"), parse_month("m").cast("string").alias("b"),
        F.try_to_date(F.substring("d", 1, 8), "yyyyMMdd").cast("string").alias("x"),
        F.try_to_date(F.concat("m", F.lit("-01")), "yyyy-MM-dd").cast("string").alias("y"))
    assert all(r.a == r.x and r.b == r.y for r in df.collect())
    cast_only = spark.range(1).select(parse_yyyymmdd(F.lit("20010203")))._jdf.queryExecution().analyzed().toString()
    assert "yyyyMMdd" not in cast_only


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_exchanged_once(spark, tables):
    """One exchange of the lines and one of ``part`` serve the sums, the walk, the
    neighbours and the join."""
    for name in ("verified_panel", "trajectory_features"):
        assert _exchanges(queries.QUERIES[name](spark, tables)) == 2, name


def test_search_by_loan_is_moved_below_the_windows(spark, tables):
    plan = queries.QUERIES["account_latest_rows"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window [", 0, plan.index("RepartitionByExpression")):]
    assert "Contains(lower(concat(LN" in below and "Contains(lower(concat(ANON_" in below


@pytest.mark.parametrize("copies", [1, 2, 3, 5])
def test_neighbours_of_copies_equal_a_window_over_the_copies(spark, copies):
    r = random.Random(copies)
    rows = [(k, m, r.choice([0.0, 0.0, 40.0, 95.0])) for k in range(4) for m in sorted(r.sample(range(12), 2 + 2 * k))]
    df = spark.createDataFrame(rows, "k long, ym int, x double")
    part = spark.createDataFrame([(k, c, copies + k % 2) for k in range(4) for c in range(copies + k % 2)],
                                 "k long, _copy int, _copies int")
    payload, wanted = {"s": (F.col("x") > 30).cast("int"), "x": "x"}, {"lags": 3, "lead": True, "run_of": "s"}
    late = sequence.loan_neighbours(df.join(part, "k").drop("_copies"), payload, key="k", order=("ym", "_copy"), **wanted).drop("_copy")
    early = sequence.neighbours_of_copies(
        sequence.loan_neighbours(df, payload, key="k", order=("ym",), **wanted).join(part, "k"), payload, **wanted)
    assert sorted(late.columns) == sorted(early.columns)
    early = early.select(*late.columns)
    assert canon([tuple(x) for x in late.collect()], late.columns) == canon([tuple(x) for x in early.collect()], late.columns)


def test_features_on_narrow_rows_keep_parts_listed_twice(spark, tables):
    from riskflow.operators import clean, features
    from riskflow.plans.pipeline import Portfolio
    p = Portfolio(spark, tables)
    wide = features.trajectory_features(clean.verified_columns(p.panel), with_next=True, bounded=True)
    for got in (p.featured, p.written_features()):
        assert got.columns == wide.columns and got.schema.simpleString() == wide.schema.simpleString()
        assert wide.exceptAll(got).count() == got.exceptAll(wide).count() == 0
    verified = clean.verified_panel(p.panel, bounded=True)
    assert verified.exceptAll(p.verified).count() == p.verified.exceptAll(verified).count() == 0


def test_numbers_read_dates_as_the_formatter_does(spark):
    from riskflow.functions.columns import parse_month, parse_yyyymmdd
    rows = [("+2001010", "2001-+1"), (" 2001011", "2001- 1"), ("20010230", "2001-1 "), ("20011231", "0999-01"), ("09990101", "2001-00"),
            ("2001.101", "2001/01"), ("20011301", "2001-1."), ("20010100", "99999-1"), ("2001０101", "2001-０1"), ("", ""), ("20000229", "2001-12 ")]
    df = spark.createDataFrame(rows, "d string, m string").select(
        "d", "m", parse_yyyymmdd("d").cast("string").alias("a"), parse_month("m").cast("string").alias("b"),
        F.when(F.col("d").rlike(r"^[0-9]{8}"), F.try_to_date(F.substring("d", 1, 8), "yyyyMMdd")).cast("string").alias("x"),
        F.try_to_date(F.concat("m", F.lit("-01")), "yyyy-MM-dd").cast("string").alias("y"))
    assert all(r.a == r.x and r.b == r.y for r in df.collect())


def test_dates_are_read_once_a_row(spark, tables):
    plan = queries.QUERIES["verified_panel"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("make_date(") == 2


def test_copies_lie_in_the_order_of_their_neighbours(spark, tables):
    from riskflow.plans.pipeline import Portfolio
    p = Portfolio(spark, tables)
    for df in (p.verified, p.featured):
        rows = df.where(F.col("loan_id") == "LN000002").select("observation_month", "risk_state", "next_risk_state").collect()
        assert len(rows) == 24 and rows[-1].next_risk_state is None
        assert all(a.next_risk_state == b.risk_state and a.observation_month <= b.observation_month
                   for a, b in zip(rows, rows[1:]))
