"""Sources and sinks: write/read round trips keep rows, order keys and schemas."""

import csv
import os
import tempfile

from pyspark.sql import functions as F

from riskflow.operators import clean, transitions
from riskflow.schema import PANEL_NAMES
from riskflow.sources import panel as P
from riskflow.sources import sinks

SF = "/root/testdata/sf0.001"


def test_adapter_grain_and_counts(spark):
    p = P.panel_from_tpch(spark, SF)
    assert p.count() == 4999
    assert p.select("loan_id", "observation_month").distinct().count() == 4999
    assert set(PANEL_NAMES) <= set(p.columns)


def test_panel_csv_roundtrip_with_row_seq(spark):
    out = tempfile.mkdtemp(prefix="rf-test-")
    p = P.panel_from_tpch(spark, SF).drop("row_seq")
    p.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/panel_csv")
    back = P.scan_panel(spark, f"{out}/panel_csv", fmt="csv")
    assert back.count() == 4999 and "row_seq" in back.columns
    assert back.select("row_seq").distinct().count() == 4999
    a = transitions.transition_counts(clean.transition_pairs(clean.verified_panel(back)))
    b = transitions.transition_counts(clean.transition_pairs(clean.verified_panel(P.panel_from_tpch(spark, SF))))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_partitioned_panel_prunes_months(spark):
    out = tempfile.mkdtemp(prefix="rf-test-")
    v = clean.verified_panel(P.panel_from_tpch(spark, SF))
    sinks.write_panel(v, f"{out}/verified")
    assert len([d for d in os.listdir(f"{out}/verified") if d.startswith("observation_month=")]) == \
        v.select("observation_month").distinct().count()
    back = spark.read.schema(v.schema).parquet(f"{out}/verified")
    q = back.filter(F.col("observation_month") == "2001-06")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observation_month" in plan
    assert q.count() == v.filter(F.col("observation_month") == "2001-06").count()


def test_matrix_csv_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="rf-test-")
    pairs = clean.transition_pairs(clean.verified_panel(P.panel_from_tpch(spark, SF)))
    long = transitions.transition_matrix(pairs)
    wide = long.groupBy("from_state").pivot("to_state", ["Low", "Medium", "High", "Default"]).agg(F.first("p"))
    sinks.write_matrix(wide.withColumnRenamed("from_state", "From"), f"{out}/P", fmt="csv")
    back = P.scan_matrix(spark, f"{out}/P")
    got = {(r.from_state, r.to_state): r.p for r in back.collect()}
    want = {(r.from_state, r.to_state): r.p for r in long.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_group_matrices_file_keys(spark):
    out = tempfile.mkdtemp(prefix="rf-test-")
    df = spark.createDataFrame([("Early Stage", 1.0), ("Institutional Banking", 2.0)], "g string, p double")
    sinks.write_group_matrices(df, f"{out}/g", "g")
    assert sorted(os.listdir(f"{out}/g"))[:2] == ["_SUCCESS", "group_key=EARLY_STAGE"] or \
        "group_key=INSTITUTIONAL_BANKING" in os.listdir(f"{out}/g")


def test_long_part_keys_are_different_loans(spark):
    ids = spark.createDataFrame([(7,), (100000,), (999999,), (1000000,), (1000001,)], "k bigint")
    assert [r[0] for r in ids.select(P._loan_id(F.col("k"))).collect()] == [
        "LN000007", "LN100000", "LN999999", "LN1000000", "LN1000001"]


def test_long_part_keys_keep_their_rows(spark, tmp_path):
    import datetime
    days = [datetime.date(2001, m, 3) for m in (1, 2, 3)]
    li = [(k, d, "N", float(k % 7)) for k in (100000, 1000000) for d in days]
    spark.createDataFrame(li, "l_partkey bigint, l_shipdate date, l_returnflag string, l_quantity double") \
         .write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "b", "t", 1, 1.0) for k in (100000, 1000000)],
                          "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double") \
         .write.parquet(str(tmp_path / "part.parquet"))
    got = P.panel_from_tpch(spark, str(tmp_path)).groupBy("loan_id").count().collect()
    assert sorted(map(tuple, got)) == [("LN100000", 3), ("LN1000000", 3)]


def _panel_csv(folder, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "p.csv", "w") as f:
        f.write("\n".join(",".join(r) for r in [header, *rows]) + "\n")
    return str(folder)


def test_scan_reads_columns_by_name(spark, tmp_path):
    header = ["extra", *PANEL_NAMES[::-1]]
    values = {n: "1" for n in PANEL_NAMES} | {"loan_id": "000123", "customer_id": "C9", "observation_month": "2024-01",
                                              "days_in_arrears": "NaN", "interest_rate": "", "segment": "nan",
                                              "principal_balance": "12.5"}
    path = _panel_csv(tmp_path / "a", header, [["e", *[values[n] for n in header[1:]]]])
    r = P.scan_panel(spark, path, fmt="csv").first()
    assert (r.loan_id, r.customer_id, r.extra, r.principal_balance) == ("000123", "C9", "e", 12.5)
    assert r.days_in_arrears is None and r.interest_rate is None and r.segment is None
    assert r.row_seq is not None


def test_scan_refuses_a_missing_column(spark, tmp_path):
    import pytest
    header = [n for n in PANEL_NAMES if n not in ("loan_id", "segment")]
    path = _panel_csv(tmp_path / "b", header, [["1"] * len(header)])
    with pytest.raises(ValueError, match="loan_id, segment"):
        P.scan_panel(spark, path, fmt="csv")


def test_row_seq_is_stored_once(spark, tmp_path):
    p = P.panel_from_tpch(spark, SF).drop("row_seq")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    a = P.scan_panel(spark, str(tmp_path / "in"), store=str(tmp_path / "kept"))
    b = P.scan_panel(spark, str(tmp_path / "kept"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        c = P.scan_panel(spark, str(tmp_path / "kept")).select("loan_id", "observation_month", "row_seq")
        assert sorted(map(tuple, c.collect())) == sorted(map(tuple, a.select(*c.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert a.count() == b.count() == 4999


def test_ingestion_order_does_not_depend_on_splits(spark, tmp_path):
    p = P.panel_from_tpch(spark, SF).drop("row_seq")
    p.repartition(3).write.option("header", True).csv(str(tmp_path / "csv"))
    p.repartition(3).write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "parquet"))
    plain = []
    for name in sorted(f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")):
        with open(tmp_path / "csv" / name, newline="") as f:
            plain += [(r["loan_id"], r["observation_month"]) for r in csv.DictReader(f)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for kind in ("csv", "parquet"):
        got = []
        for size in (old, "40000", "700000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                rows = P.scan_panel(spark, str(tmp_path / kind), fmt=kind).select(
                    "row_seq", "loan_id", "observation_month").collect()
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            got.append(sorted(map(tuple, rows)))
        assert got[0] == got[1] == got[2]
        assert [r[0] for r in got[0]] == list(range(4999))
        if kind == "csv":
            assert [r[1:] for r in got[0]] == plain


def test_ingesting_an_empty_panel(spark, tmp_path):
    P.panel_from_tpch(spark, SF).drop("row_seq").limit(0).write.parquet(str(tmp_path / "none"))
    back = P.scan_panel(spark, str(tmp_path / "none"))
    assert back.count() == 0 and "row_seq" in back.columns
