"""Transition counts and matrices.

The count grid is one aggregate: k*k conditional counts per group, so every
cell exists (zero-filled) without a grid cross join, map-side partial
aggregation does nearly all the work, and the shuffle carries one small row
per group per map task. Matrices come out in two interchangeable forms:

* packed: ``(by..., n_total, counts array<array<bigint>>, P array<array<double>>)``
* long:   ``(by..., from_state, to_state, from_idx, to_idx, n_pairs, p)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.columns import lifecycle_stage  # noqa: F401
from riskflow.functions.matrix import mat_get
from riskflow.operators.sequence import with_neighbours
from riskflow.states import STATES


def _labels(states):
    return F.array(*[F.lit(s) for s in states])


def count_grid(pairs: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
               from_col: str = "risk_state", to_col: str = "next_risk_state") -> DataFrame:
    """Packed counts per group: ``(by..., n_total, counts)``."""
    by = list(by or [])
    f, t = F.col(from_col), F.col(to_col)
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            aggs.append(F.count_if((f == a) & (t == b)).alias(f"_c{i}_{j}"))
    g = pairs.groupBy(*by).agg(*aggs)
    k = len(states)
    counts = F.array(*[F.array(*[F.col(f"_c{i}_{j}") for j in range(k)]) for i in range(k)])
    return g.select(*by, "n_total", counts.alias("counts"))


def normalise_rows(counts, empty_row: str = "null"):
    """Row-normalise packed counts. ``empty_row`` is what a row with no pairs
    becomes: ``"null"`` (0/0, the verified-panel matrix) or ``"zero"``
    (segment / lifecycle / model matrices)."""
    def norm(row):
        tot = F.aggregate(row, F.lit(0).cast("bigint"), lambda a, x: a + x)
        if empty_row == "zero":
            den = F.when(tot == 0, F.lit(1)).otherwise(tot).cast("double")
            return F.transform(row, lambda x: x.cast("double") / den)
        return F.transform(row, lambda x: F.try_divide(x.cast("double"), tot.cast("double")))
    return F.transform(counts, norm)


def transition_matrix_packed(pairs: DataFrame, by: list[str] | None = None,
                             states: list[str] = STATES, from_col: str = "risk_state",
                             to_col: str = "next_risk_state", min_pairs: int = 0,
                             empty_row: str = "null") -> DataFrame:
    by = list(by or [])
    g = count_grid(pairs, by, states, from_col, to_col)
    if min_pairs:
        g = g.filter(F.col("n_total") >= min_pairs)
    return g.withColumn("P", normalise_rows(F.col("counts"), empty_row))


def to_long(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
            matrix_col: str = "P", value: str = "p", with_counts: bool = True) -> DataFrame:
    """Packed matrix -> one row per cell (k*k rows per group)."""
    by = list(by or [])
    k = len(states)
    cells = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_cell")
    df = packed.select(*by, *([c for c in ("counts",) if with_counts and c in packed.columns]),
                       matrix_col, cells)
    i = (F.col("_cell") / k).cast("int")
    j = (F.col("_cell") % k).cast("int")
    out = [*by,
           F.element_at(_labels(states), i + 1).alias("from_state"),
           F.element_at(_labels(states), j + 1).alias("to_state"),
           i.alias("from_idx"), j.alias("to_idx")]
    if with_counts and "counts" in packed.columns:
        out.append(mat_get(F.col("counts"), i, j).alias("n_pairs"))
    out.append(mat_get(F.col(matrix_col), i, j).alias(value))
    return df.select(*out)


def transition_counts(pairs: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                      from_col: str = "risk_state", to_col: str = "next_risk_state") -> DataFrame:
    """A5: full zero-filled crosstab in long form ``(by..., from_state, to_state, n_pairs)``."""
    by = list(by or [])
    g = count_grid(pairs, by, states, from_col, to_col)
    k = len(states)
    cells = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_cell")
    i = (F.col("_cell") / k).cast("int")
    j = (F.col("_cell") % k).cast("int")
    return g.select(*by, "counts", cells).select(
        *by, F.element_at(_labels(states), i + 1).alias("from_state"),
        F.element_at(_labels(states), j + 1).alias("to_state"),
        i.alias("from_idx"), j.alias("to_idx"),
        mat_get(F.col("counts"), i, j).alias("n_pairs"))


def transition_matrix(pairs: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                      from_col: str = "risk_state", to_col: str = "next_risk_state",
                      min_pairs: int = 0, empty_row: str = "null") -> DataFrame:
    """Long-form row-normalised matrix."""
    packed = transition_matrix_packed(pairs, by, states, from_col, to_col, min_pairs, empty_row)
    return to_long(packed, by, states)


# Segment matrices need more than 50 pairs, stage matrices at least 100.
SEGMENT_MIN_PAIRS = 51
STAGE_MIN_PAIRS = 100
UNKNOWN_SEGMENT = "UNKNOWN"


def segment_transition_matrices(pairs: DataFrame, states: list[str] = STATES,
                                packed: bool = False) -> DataFrame:
    """One matrix per segment except UNKNOWN, only with > 50 pairs; empty rows -> 0."""
    src = pairs.filter(F.col("segment") != UNKNOWN_SEGMENT)
    pk = transition_matrix_packed(src, ["segment"], states, min_pairs=SEGMENT_MIN_PAIRS,
                                  empty_row="zero")
    return pk if packed else to_long(pk, ["segment"], states)


def lifecycle_transition_matrices(pairs: DataFrame, states: list[str] = STATES,
                                  packed: bool = False) -> DataFrame:
    """One matrix per lifecycle stage with >= 100 pairs; empty rows -> 0."""
    from riskflow.operators.features import with_lifecycle_stage
    src = with_lifecycle_stage(pairs) if "lifecycle_stage" not in pairs.columns else pairs
    pk = transition_matrix_packed(src, ["lifecycle_stage"], states, min_pairs=STAGE_MIN_PAIRS,
                                  empty_row="zero")
    return pk if packed else to_long(pk, ["lifecycle_stage"], states)


def _rate(P, states, a, b):
    return F.round(mat_get(P, states.index(a), states.index(b)), 4)


def key_rates(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES) -> DataFrame:
    """Low->Low, Medium->Low, High->Default, Default->Default, 4 dp."""
    by = list(by or [])
    P = F.col("P")
    return packed.select(*by,
                         _rate(P, states, "Low", "Low").alias("low_retention"),
                         _rate(P, states, "Medium", "Low").alias("medium_recovery"),
                         _rate(P, states, "High", "Default").alias("high_to_default"),
                         _rate(P, states, "Default", "Default").alias("default_persist"))


def group_key_rates(packed: DataFrame, by: list[str], states: list[str] = STATES) -> DataFrame:
    """A10: the three rates compared across segments / stages."""
    P = F.col("P")
    return packed.select(*by, "n_total",
                         _rate(P, states, "Default", "Default").alias("default_persist"),
                         _rate(P, states, "High", "Default").alias("high_to_default"),
                         _rate(P, states, "Medium", "Low").alias("medium_recovery"))


# Fixed value: a High->Default spread above 5 points means stage matters.
LIFECYCLE_EFFECT_THRESHOLD = 0.05


def lifecycle_effect(stage_packed: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Max - min of High->Default across stages (only when >= 2 stages)."""
    hd = mat_get(F.col("P"), states.index("High"), states.index("Default"))
    agg = stage_packed.agg(F.count(F.lit(1)).alias("n_stages"),
                           F.max(hd).alias("max_high_to_default"),
                           F.min(hd).alias("min_high_to_default"))
    spread = F.col("max_high_to_default") - F.col("min_high_to_default")
    return agg.filter(F.col("n_stages") >= 2).select(
        "n_stages", F.round("max_high_to_default", 6).alias("max_high_to_default"),
        F.round("min_high_to_default", 6).alias("min_high_to_default"),
        F.round(spread, 6).alias("spread"),
        (spread > LIFECYCLE_EFFECT_THRESHOLD).alias("significant"))


def model_transition_matrix(df: DataFrame, pred_col: str = "pred", key: str = "loan_id",
                            order=("observation_month", "row_seq"),
                            states: list[str] = STATES, bounded: bool = False) -> DataFrame:
    """Predicted state x next row's predicted state, per loan (row shift)."""
    pairs = with_neighbours(df, {"p": pred_col}, lead=True, key=key, order=order, bounded=bounded).select(
        pred_col, F.col("_next.p").alias("_next_pred")).filter(F.col("_next_pred").isNotNull())
    return transition_matrix_packed(pairs, [], states, pred_col, "_next_pred", empty_row="zero")


def compare_matrices(empirical: DataFrame, models: DataFrame, states: list[str] = STATES) -> DataFrame:
    """MAE over all k*k cells vs the empirical P, plus three model rates, 4 dp.

    ``empirical``: packed ``P`` (one row); ``models``: packed ``(model, P)`` rows.
    Both go to long form and meet on the cell index (an equi-join with a
    k*k-row side), then one grouped average per model.
    """
    emp = to_long(empirical.select("P"), [], states, with_counts=False).select(
        "from_idx", "to_idx", F.col("p").alias("p_emp"))
    mod = to_long(models.select("model", "P"), ["model"], states, with_counts=False)
    cells = mod.join(F.broadcast(emp), ["from_idx", "to_idx"])

    def cell(a, b):
        return F.max(F.when((F.col("from_state") == a) & (F.col("to_state") == b), F.col("p")))
    return cells.groupBy("model").agg(
        F.round(F.avg(F.abs(F.col("p") - F.col("p_emp"))), 4).alias("mae"),
        F.round(cell("High", "Default"), 4).alias("high_to_default"),
        F.round(cell("Medium", "High"), 4).alias("medium_to_high"),
        F.round(cell("Default", "Default"), 4).alias("default_persist"))


# Five-state artifact: High split at 60 DPD (sub-standard 31-60, doubtful 61-90).
def five_state_label(dpd_col: str = "days_in_arrears"):
    d = F.col(dpd_col)
    return (F.when(d == 0, "Low").when((d >= 1) & (d <= 30), "Medium")
            .when((d >= 31) & (d <= 60), "High-SubStd").when((d >= 61) & (d <= 90), "High-Doubtful")
            .when(d > 90, "Default"))
