"""Panel sources.

* ``scan_panel`` reads a loan panel (CSV with header, or Parquet) by column name
  and stores an ingestion order ``row_seq`` where the input has none.
* ``panel_from_tpch`` derives a deterministic loan panel from the driver's
  ``lineitem`` + ``part`` tables (grain: part x ship month).
* ``scan_matrix`` reads a saved matrix (CSV with an index column) into the
  long form ``(from_state, to_state, p)`` reindexed to the state order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.functions.columns import state_from_dpd
from riskflow.schema import PANEL_NAMES, PANEL_SCHEMA, ROW_SEQ
from riskflow.session import ensure_checkpoint_dir, write_stage
from riskflow.states import STATES


# Text that stands for a missing value in a panel file (fixed values).
MISSING_TEXT = ["", "nan", "na", "n/a", "null", "none"]


def scan_panel(spark: SparkSession, path: str, fmt: str | None = None, store: str | None = None) -> DataFrame:
    """Read a panel by column name.

    Columns are taken from the header (CSV) or the schema (Parquet), whatever
    their order, and cast to the panel's types; further columns are kept after
    them. A missing panel column is an error, as is a file whose header
    differs from the first one. NaN and its spellings are null.

    ``row_seq``, the ingestion order that decides between rows of one loan and
    month, is the row's number by file name and place in its file, from 0, so
    another ingest with other split sizes gives the same. Where the input has
    none, the panel is written once with it - to ``store`` or the session's
    shared folder - and read from there.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    else:
        df = spark.read.parquet(path)
    lost = [n for n in PANEL_NAMES if n not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks the panel columns {', '.join(lost)}")
    cols = []
    for field in [*PANEL_SCHEMA.fields, T.StructField(ROW_SEQ, T.LongType())]:
        if field.name not in df.columns:
            continue
        c = F.col(f"`{field.name}`")
        if isinstance(df.schema[field.name].dataType, T.StringType):
            c = F.when(~F.lower(F.trim(c)).isin(MISSING_TEXT), c)
        c = c.cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(field.name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in PANEL_NAMES and c != ROW_SEQ]
    if ROW_SEQ in df.columns:
        return df.select(*cols, *extra)
    store = store or f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskflow-panel-{uuid.uuid4().hex[:12]}"
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("id"))
    out = _numbered(df.select(F.struct(*cols, *extra).alias("row"), place.alias("place")))
    out.write.parquet(store)
    return spark.read.schema(out.schema).parquet(store)


def _numbered(placed: DataFrame) -> DataFrame:
    """``row`` with the row's number by file and place. A task reads a split from
    its start to its end, so ids follow one another within it; the numbers at
    which splits begin are a running sum over one row per split. The read is
    written first: ids and splits are those of a single scan."""
    stage = write_stage(placed, "ingest")
    splits = stage.groupBy("place.file", "place.start").agg(F.min("place.id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    rows = stage.join(splits, (F.col("place.file") == splits.file) & (F.col("place.start") == splits.start))
    return rows.select("row.*", (F.col("place.id") + F.col("shift")).alias(ROW_SEQ))


def scan_transitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_matrix(spark: SparkSession, path: str, states: list[str] = STATES,
                index_col: str | None = None) -> DataFrame:
    """CSV matrix with the from-state in its first column -> long form.

    Missing states (row or column) come back as null probabilities, like
    ``reindex`` without a fill value.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    idx = index_col or raw.columns[0]
    present = [c for c in states if c in raw.columns]
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in present)
    long = raw.selectExpr(f"`{idx}` AS from_state",
                          f"stack({len(present)}, {stack}) AS (to_state, p)")
    grid = [(f, i, t, j) for i, f in enumerate(states) for j, t in enumerate(states)]
    g = spark.createDataFrame(grid, "from_state string, from_idx int, to_state string, to_idx int")
    return (g.join(long, ["from_state", "to_state"], "left")
             .select("from_state", "to_state", "from_idx", "to_idx", "p"))


# ---------------------------------------------------------------------------
# Deterministic panel over the driver's TPC-H-like tables.
# Fixed values (the adapter's formulas, shared with the SQL oracle):
#   segment by p_size mod 20: 0 CORPORATE, 1-2 AGRICULTURE, 3-5 SME, 6 null, else RETAIL
#   loan_term_months = 12 + 12 * (k mod 8), 0 when k mod 211 = 0
#   malformed disbursement date '2024131x' when k mod 101 = 0
# ---------------------------------------------------------------------------

def _monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per part and ship month. The lines are exchanged once, by part, and so stay
    for all that follows (aggregate, windows, join); nothing of a part is held but a sum
    per month. Parts have few lines a month, so sums before the exchange save little."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # group on an integer yyyymm (cheaper to hash and to sort than a formatted string)
    ym = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    flag = F.col("l_returnflag")
    turn = F.when(flag == "R", 1).when(flag == "N", -1).otherwise(0)
    return (li.where(F.col("l_partkey").isNotNull())
            .select(F.col("l_partkey").alias("k"), ym.alias("ym"), turn.alias("turn"), "l_quantity")
            .repartition("k").groupBy("k", "ym")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turn"),
                 F.sum("l_quantity").cast("bigint").alias("q")))


def _loan_id(k):
    """LN and the part key, padded to six digits. ``lpad`` also shortens, so a
    longer key is taken as it is."""
    s = k.cast("string")
    return F.concat(F.lit("LN"), F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s))


# The adapter's own month, one for one with ``observation_month`` and cheaper to sort and to carry.
MONTH_KEY = "ym"


def panel_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (part, ship month): a loan whose arrears walk up and down."""
    return panel_columns(panel_core(spark, sf_dir)).select(*PANEL_NAMES, ROW_SEQ)


def panel_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the panel's columns are formed from: the walk of each loan and the row of ``part``."""
    return with_part(loan_months(spark, sf_dir), spark, sf_dir).drop("_copy", "_copies")


# What marks a loan in the narrow rows: one for one with ``loan_id``, cheaper to hash and to sort.
LOAN_KEY = "k"


def loan_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrears walk of each loan, one narrow row per (part, ship month).

    Plan: ONE exchange of the lines by part key, then the sums per month and one sort
    for the per-loan windows (each window group holds at most one row per calendar
    month). ``part`` joins on the same key, and neighbouring rows are windowed by it
    before that join, so the panel is shuffled and sorted once end to end; its columns
    are formed last. A filter on ``loan_id`` or ``customer_id`` is one on the key,
    so the optimizer moves it below all of this.
    """
    m = _monthly_lines(spark, sf_dir)
    w = Window.partitionBy(LOAN_KEY).orderBy(MONTH_KEY)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = m.select("k", "ym", "n", "q", F.signum("turn").cast("int").alias("step"))
    s = s.select("k", "ym", "n", "q", F.sum("step").over(run).alias("cs"),
                 F.sum(F.when(F.col("step") <= 0, 1).otherwise(0)).over(run).alias("paid"),
                 F.min("ym").over(run).alias("first_ym"))
    s = s.select("k", "ym", "n", "q", "paid", "first_ym",
                 (F.col("cs") - F.least(F.lit(0), F.min("cs").over(run))).alias("wv"))
    s = s.select("*", F.max("wv").over(run).alias("mx"))
    q = F.col("q")
    dpd = (F.when(F.col("mx") >= 4, 91 + q % 120)
            .when(F.col("wv") == 0, F.lit(0))
            .when(F.col("wv") == 1, 1 + q % 30)
            .otherwise(31 + q % 60)).cast("double")
    return s.select("k", "ym", "n", "q", "paid", "first_ym", "wv", dpd.alias("days_in_arrears"))


def with_part(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``loan_id`` and the row of ``part`` to rows of :func:`loan_months`. A key that
    ``part`` holds several times gives as many copies of a row: ``_copy`` of ``_copies``. A
    merge gives the copies of a row in that order, so rows lie as their neighbours say; a
    hashed side would give them backwards."""
    facts = ["p_brand", "p_type", "p_size", "p_retailprice"]
    same = Window.partitionBy("k")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), *facts)
    part = part.select("*", (F.row_number().over(same.orderBy(*facts)) - 1).alias("_copy"),
                       F.count(F.lit(1)).over(same).alias("_copies"))
    return with_loan(rows.join(part.hint("merge"), "k", "inner"))


def with_loan(rows: DataFrame) -> DataFrame:
    """Narrow rows with the loan's id and the ingestion order, which their key stands for."""
    return rows.select(_loan_id(F.col(LOAN_KEY)).alias("loan_id"), "*", F.lit(0).cast("bigint").alias(ROW_SEQ))


def month_label():
    ym = F.col(MONTH_KEY)
    return F.concat((ym / 100).cast("int").cast("string"), F.lit("-"),
                    F.lpad((ym % 100).cast("string"), 2, "0"))


def panel_columns(core: DataFrame) -> DataFrame:
    """The panel's columns, with the others of ``core`` after them."""
    q, k = F.col("q"), F.col("k")
    size20 = F.col("p_size") % 20
    segment = (F.when(size20 == 0, "CORPORATE").when(size20.between(1, 2), "AGRICULTURE")
                .when(size20.between(3, 5), "SME").when(size20 == 6, F.lit(None))
                .otherwise("RETAIL"))
    # k mod 24 months before the first month, in months since year 0: plain numbers,
    # parsing and formatting a date per row took a third of the panel's time
    months = F.floor(F.col("first_ym") / 100) * 12 + F.col("first_ym") % 100 - 1 - k % 24
    disb_date = F.when(k % 101 == 0, F.lit("2024131x")).otherwise(
        F.concat(F.lpad(F.floor(months / 12).cast("string"), 4, "0"),
                 F.lpad((months % 12 + 1).cast("string"), 2, "0"), F.lit("01")))
    label = F.col("observation_month") if "observation_month" in core.columns else month_label()
    kept = [c for c in core.columns if c not in PANEL_NAMES and c != ROW_SEQ]
    # named several times by what follows: formed once, while the rows are narrow
    core = core.withColumns({"observation_month": label, "risk_state": state_from_dpd("days_in_arrears"),
                             "disbursement_date": disb_date})
    disbursed = F.col("p_retailprice") * F.lit(1000.0)
    paid = F.col("paid").cast("double")
    days = F.col("days_in_arrears")
    qd = q.cast("double")
    return core.select(
        "loan_id",
        F.concat(F.lit("ANON_"), (k % 997).cast("string")).alias("customer_id"),
        "observation_month",
        "risk_state",
        F.col("risk_state").alias("performance_class"),
        days.alias("days_in_arrears"),
        F.col("wv").cast("double").alias("instalments_in_arrears"),
        segment.alias("segment"),
        F.col("p_brand").alias("loan_type"),
        F.concat(F.lit("BR"), (k % 7).cast("string")).alias("branch_name"),
        F.col("p_type").alias("isic_industry_name"),
        "disbursement_date",
        F.when(k % 211 == 0, F.lit(0.0)).otherwise(12.0 + 12.0 * (k % 8)).alias("loan_term_months"),
        paid.alias("number_instalments_paid"),
        disbursed.alias("disbursed_amount_lcy"),
        (disbursed * (F.lit(1.0) - F.least(F.lit(1.0), paid / F.lit(60.0)))).alias("principal_balance"),
        (qd * 100.0).alias("principal_due"),
        F.when(days > 0, days * 5.0).alias("penal_interest"),
        F.when(days > 90, qd * 7.0).alias("suspended_interest"),
        (qd * 10.0).alias("interest_due"),
        (qd * 3.0).alias("accrued_interest"),
        (F.col("n").cast("double") * 1000.0).alias("all_crb"),
        (12.0 + (k % 10)).cast("double").alias("interest_rate"),
        ROW_SEQ, *kept)
