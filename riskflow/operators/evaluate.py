"""Model evaluation.

Inputs are scored tables with an actual and a predicted state column. Every
metric is a single aggregate (conditional counts) followed by arithmetic on
a handful of rows, so the full test set is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.transitions import count_grid, normalise_rows, to_long
from riskflow.states import STATES


def confusion_matrix(df: DataFrame, actual: str = "next_risk_state", pred: str = "pred",
                     states: list[str] = STATES, by: list[str] | None = None) -> DataFrame:
    """Full k x k grid ``(actual, predicted, n)``, zero-filled."""
    g = count_grid(df, by, states, actual, pred).withColumn("P", F.col("counts"))
    long = to_long(g, by, states, matrix_col="counts", value="n", with_counts=False)
    return long.select(*(by or []), F.col("from_state").alias("actual"),
                       F.col("to_state").alias("predicted"), "n")


def row_normalised_confusion(df: DataFrame, actual: str = "next_risk_state", pred: str = "pred",
                             states: list[str] = STATES) -> DataFrame:
    """Confusion rows divided by their totals (empty row -> 0).
    Called the "predicted transition matrix" in the reference. Packed ``P``."""
    g = count_grid(df, None, states, actual, pred)
    return g.withColumn("P", normalise_rows(F.col("counts"), "zero"))


def empirical_matrix(pairs: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Current state x actual next state, empty rows -> 0 (packed)."""
    return row_normalised_confusion(pairs, "risk_state", "next_risk_state", states)


def transition_mae(df: DataFrame, packed_P: DataFrame, actual: str = "next_risk_state",
                   pred: str = "pred", states: list[str] = STATES) -> DataFrame:
    """MAE between A19 and the empirical P over all k*k cells."""
    from riskflow.operators.transitions import compare_matrices
    m = row_normalised_confusion(df, actual, pred, states).select(F.lit("model").alias("model"), "P")
    return compare_matrices(packed_P, m, states).select(F.col("mae").alias("transition_mae"))


def class_report(df: DataFrame, actual: str = "next_risk_state", pred: str = "pred",
                 states: list[str] = STATES, digits: int = 6) -> DataFrame:
    """Precision, recall, F1, support per class (undefined -> 0), plus
    ``macro avg`` and ``accuracy`` rows."""
    a, p = F.col(actual), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(a == p).alias("_ok")]
    for i, s in enumerate(states):
        aggs += [F.count_if((a == s) & (p == s)).alias(f"tp{i}"),
                 F.count_if(p == s).alias(f"pp{i}"), F.count_if(a == s).alias(f"ap{i}")]
    g = df.agg(*aggs)

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))
    rows = []
    for i, s in enumerate(states):
        prec = safe(F.col(f"tp{i}").cast("double"), F.col(f"pp{i}"))
        rec = safe(F.col(f"tp{i}").cast("double"), F.col(f"ap{i}"))
        f1 = safe(2 * prec * rec, prec + rec)
        rows.append(F.struct(F.lit(s).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), F.col(f"ap{i}").cast("bigint").alias("support"),
                             F.col(f"pp{i}").cast("bigint").alias("_pp")))
    per = g.select("_n", "_ok", F.explode(F.array(*rows)).alias("r")).select("_n", "_ok", "r.*")
    # macro average over the labels seen in either column (scikit-learn's label set)
    seen = per.filter((F.col("support") > 0) | (F.col("_pp") > 0))
    macro = seen.groupBy().agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                               F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                               F.sum("support").cast("bigint").alias("support"))
    acc = g.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   safe(F.col("_ok").cast("double"), F.col("_n")).alias("f1"),
                   F.col("_n").cast("bigint").alias("support"))
    out = per.drop("_n", "_ok", "_pp").unionByName(macro).unionByName(acc)
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


# Thresholds 0.15 .. 0.50 in steps of 0.05.
SWEEP_THRESHOLDS = [0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


def threshold_sweep(df: DataFrame, prob: str = "p_high", actual: str = "next_risk_state",
                    target: str = "High", thresholds=SWEEP_THRESHOLDS, digits: int = 6) -> DataFrame:
    """Recall, precision and flagged count of ``prob >= t`` for each t.
    One aggregate with 3 conditional counts per threshold, then unpivot."""
    p, a = F.col(prob), F.col(actual) == target
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((p >= t) & a).alias(f"tp{i}"), F.count_if((p >= t) & ~a).alias(f"fp{i}"),
                 F.count_if((p < t) & a).alias(f"fn{i}")]
    g = df.agg(*aggs)
    rows = []
    for i, t in enumerate(thresholds):
        tp, fp, fn = (F.col(f"{x}{i}") for x in ("tp", "fp", "fn"))
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        pre = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), F.round(rec, digits).alias("recall_high"),
                             F.round(pre, digits).alias("precision_high"),
                             (tp + fp).cast("bigint").alias("n_flagged")))
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Report order of current states and the two cut-offs.
RECALL_STATE_ORDER = ["High", "Medium", "Default", "Low"]


def recall_by_current_state(df: DataFrame, prob: str = "p_high", actual: str = "next_risk_state",
                            target: str = "High", cuts=(0.50, 0.25)) -> DataFrame:
    """Among rows whose actual next state is High, caught at each cut,
    by current state (states with no rows are skipped)."""
    sub = df.filter(F.col(actual) == target)
    order = F.array_position(F.array(*[F.lit(s) for s in RECALL_STATE_ORDER]), F.col("risk_state"))
    return (sub.groupBy("risk_state")
               .agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(prob) >= cuts[0]).alias("caught_050"),
                    F.count_if(F.col(prob) >= cuts[1]).alias("caught_025"))
               .withColumn("_o", order).orderBy("_o").drop("_o"))


def compare_models(df: DataFrame, preds: dict, actual: str = "next_risk_state",
                   states: list[str] = STATES) -> DataFrame:
    """Per-model macro F1 and per-class recall in ONE pass: each row is
    stacked once per model (``explode`` of a fixed-size array), then a single
    grouped aggregate computes every class count for every model."""
    stacked = df.select(F.col(actual).alias("_a"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(i + 1).alias("model_order"), p.alias("_p"))
        for i, (name, p) in enumerate(preds.items())])).alias("_m")).select("_a", "_m.*")
    a, p = F.col("_a"), F.col("_p")
    aggs = []
    for i, s in enumerate(states):
        aggs += [F.count_if((a == s) & (p == s)).alias(f"tp{i}"), F.count_if(p == s).alias(f"pp{i}"),
                 F.count_if(a == s).alias(f"ap{i}")]
    g = stacked.groupBy("model", "model_order").agg(*aggs)

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))
    recs, f1s, seen = [], [], []
    for i in range(len(states)):
        prec = safe(F.col(f"tp{i}").cast("double"), F.col(f"pp{i}"))
        rec = safe(F.col(f"tp{i}").cast("double"), F.col(f"ap{i}"))
        recs.append(rec)
        f1s.append(safe(2 * prec * rec, prec + rec))
        seen.append((F.col(f"ap{i}") + F.col(f"pp{i}")) > 0)
    n_seen = sum((x.cast("int") for x in seen[1:]), seen[0].cast("int"))
    f1_sum = sum((F.when(sn, f) .otherwise(F.lit(0.0)) for sn, f in zip(seen[1:], f1s[1:])),
                 F.when(seen[0], f1s[0]).otherwise(F.lit(0.0)))
    return g.select("model", "model_order", (f1_sum / n_seen).alias("macro_f1"),
                    recs[states.index("High")].alias("recall_high"),
                    recs[states.index("Medium")].alias("recall_medium"))


def model_comparison(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """composite = 0.5 F1 + 0.25 recall(High) + 0.25 recall(Medium) and
    the best model (first wins on ties; ``metrics`` carries a ``model_order``).
    The ranking window runs over one row per model."""
    comp = F.col("macro_f1") * 0.5 + F.col("recall_high") * 0.25 + F.col("recall_medium") * 0.25
    m = metrics.withColumn("composite", comp)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("composite").desc(), F.col("model_order").asc())
    return m.withColumn("is_best", F.row_number().over(w) == 1).select(
        "model", *[F.round(c, digits).alias(c) for c in ("macro_f1", "recall_high", "recall_medium",
                                                          "composite")], "is_best")


def test_cutoff(df: DataFrame, n_test_months: int = 2):
    """First test month: the smallest of the last ``n_test_months`` distinct
    labelled months, as a scalar subquery (it only reads the month and label
    columns, and the comparison against it prunes month partitions)."""
    months = df.filter(F.col("next_risk_state").isNotNull()).select("observation_month").distinct()
    return months.orderBy(F.col("observation_month").desc()).limit(n_test_months) \
        .agg(F.min("observation_month").alias("_cut")).scalar()


def time_split(df: DataFrame, n_test_months: int = 2, labelled_only: bool = True) -> DataFrame:
    """the last ``n_test_months`` distinct months of the labelled rows are
    test, the rest train (a ``split`` column)."""
    d = df.filter(F.col("next_risk_state").isNotNull()) if labelled_only else df
    cut = test_cutoff(df, n_test_months)
    return d.withColumn("split", F.when(F.col("observation_month") >= cut, "test").otherwise("train"))


def train_test(df: DataFrame, n_test_months: int = 2) -> tuple[DataFrame, DataFrame]:
    """F6 as two filtered tables; the test side reads only its months."""
    d = df.filter(F.col("next_risk_state").isNotNull())
    cut = test_cutoff(df, n_test_months)
    return (d.filter(F.col("observation_month") < cut).withColumn("split", F.lit("train")),
            d.filter(F.col("observation_month") >= cut).withColumn("split", F.lit("test")))


def class_weights(df: DataFrame, label: str = "next_risk_state", out: str = "weight") -> DataFrame:
    """Balanced weight n / (k * n_c) attached to each row. The per-class
    table has one row per class (k rows), so broadcasting it is bounded by k."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy(F.lit(0))       # over k rows
    w = counts.select(label, (F.sum("_nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


def label_encoding(df: DataFrame, col: str) -> DataFrame:
    """L1: value -> index in the sorted distinct values ``(value, code)``.
    Distinct categories are few; the ranking runs on that small table."""
    d = df.select(F.col(col).alias("value")).distinct().filter(F.col("value").isNotNull())
    return d.withColumn("code", (F.dense_rank().over(
        Window.partitionBy(F.lit(0)).orderBy("value")) - 1).cast("int"))


def safe_encode(df: DataFrame, col: str, encoding: DataFrame, out: str | None = None) -> DataFrame:
    """L2: encode with a fitted table; unseen -> the first class (0). A null
    becomes the string "nan" first, which is unseen unless trained on."""
    out = out or f"{col}_enc"
    key = F.coalesce(F.col(col), F.lit("nan"))
    e = encoding.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    j = df.withColumn("_k", key).join(e, F.col("_k") == F.col("_v"), "left")
    return j.withColumn(out, F.coalesce(F.col("_code"), F.lit(0))).drop("_k", "_v", "_code")


def standardise(df: DataFrame, features: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population std (0 std -> 1, as scikit-learn does).
    Means and stds are one scalar (a struct) from one aggregate."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in features],
                            *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).alias("_st")).scalar()
    j = df.withColumn("_st", stats)
    z = []
    for c in features:
        sd = F.when(F.col(f"_st.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_st.s_{c}"))
        z.append(((F.col(c) - F.col(f"_st.m_{c}")) / sd).alias(c + suffix))
    return j.select(*df.columns, *z)

