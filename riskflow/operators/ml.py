"""Next-month risk-state models.

A ``RiskModel`` bundles what scoring needs: the fitted models (MLlib trees or a
coefficient table), the
ordered feature list, the population mean/std row used to standardise, and
the early-warning threshold. Every step is a DataFrame transformation:
training rows are never collected, scaling statistics are one aggregate row
broadcast back, and predictions come out as the same columns the
deterministic scorer produces (``p_low..p_default, pred, score, p_pred,
is_worse``), so watchlists and evaluation work unchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.functions.columns import between_flag, clip, state_from_dpd
from riskflow.operators import boosting, logistic
from riskflow.operators.evaluate import class_weights, label_encoding, safe_encode
from riskflow.operators.scoring import PROB_COLS, with_prediction_columns
from riskflow.schema import ROW_SEQ
from riskflow.session import write_stage
from riskflow.states import STATES

# The notebook's 38 training features (36 numeric + 2 encoded).
NOTEBOOK_FEATURES = [
    "days_in_arrears", "instalments_in_arrears", "arrears_ratio", "repayment_ratio",
    "prev_risk_state_code", "months_in_state", "dpd_band_position", "dpd_delta", "dpd_velocity_2m",
    "dpd_velocity_3m", "projected_dpd_next", "proj_will_be_high", "proj_will_be_default",
    "proj_will_be_medium", "proj_will_be_low", "smooth_velocity", "smooth_proj_dpd", "smooth_proj_high",
    "smooth_proj_default", "transitioning_up", "transitioning_down", "near_high_threshold",
    "near_default_threshold", "near_medium_threshold", "principal_balance", "principal_due",
    "penal_interest", "suspended_interest", "interest_due", "accrued_interest", "all_crb",
    "interest_rate", "loan_term_months", "number_instalments_paid", "disbursed_amount_lcy",
    "loan_age_months", "segment_enc", "loan_type_enc",
]

# The deployed model's 18 features, in order.
DEPLOYED_FEATURES = [
    "days_in_arrears", "instalments_in_arrears", "principal_balance", "principal_due", "penal_interest",
    "suspended_interest", "interest_due", "accrued_interest", "all_crb", "interest_rate",
    "loan_term_months", "number_instalments_paid", "disbursed_amount_lcy", "repayment_ratio",
    "loan_age_months", "arrears_ratio", "segment_enc", "loan_type_enc",
]

# Display labels of features (others display their own name).
FEATURE_LABELS = {
    "days_in_arrears": "Days in arrears", "suspended_interest": "Suspended interest",
    "arrears_ratio": "Arrears ratio", "instalments_in_arrears": "Instalments in arrears",
    "penal_interest": "Penal interest", "number_instalments_paid": "Instalments paid",
    "principal_due": "Principal due", "interest_due": "Interest due", "repayment_ratio": "Repayment ratio",
    "loan_type_enc": "Loan type", "interest_rate": "Interest rate", "all_crb": "CRB exposure",
    "principal_balance": "Principal balance", "disbursed_amount_lcy": "Disbursed amount",
    "accrued_interest": "Accrued interest", "loan_term_months": "Loan term", "loan_age_months": "Loan age",
    "segment_enc": "Customer segment",
}

# Fixed value: early-warning threshold on p_high written by training.
HIGH_RISK_THRESHOLD = 0.25
CATEGORICALS = ("segment", "loan_type")


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------

def fit_encodings(train: DataFrame, cols=CATEGORICALS) -> dict[str, DataFrame]:
    """L1 per categorical column: ``(value, code)`` over the sorted distinct values."""
    return {c: label_encoding(train.withColumn(c, F.coalesce(F.col(c), F.lit("UNKNOWN"))), c)
            for c in cols}


def apply_encodings(df: DataFrame, encodings: dict[str, DataFrame]) -> DataFrame:
    """L2: ``<col>_enc``; unseen values map to class 0."""
    for c, enc in encodings.items():
        df = safe_encode(df, c, enc, f"{c}_enc")
    return df


def fill_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing feature column -> 0; null value -> 0; all cast to double."""
    for f in features:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(0.0))
    return df.select(*[c for c in df.columns if c not in features],
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])


def with_label(df: DataFrame, label: str = "next_risk_state") -> DataFrame:
    codes = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(label)) - 1
    return df.withColumn("label", codes.cast("double"))


# ---------------------------------------------------------------------------
# Training-set augmentation
# ---------------------------------------------------------------------------

def recompute_dpd_features(df: DataFrame) -> DataFrame:
    """Derived DPD features after perturbing DPD / delta; the band position is
    taken from the DPD value itself (not from risk_state)."""
    from riskflow.operators.features import dpd_flags
    dpd, delta, v2 = F.col("days_in_arrears"), F.col("dpd_delta"), F.col("dpd_velocity_2m")
    band = (F.when((dpd >= 31) & (dpd <= 90), (dpd - 31) / 58.0)
             .when((dpd >= 1) & (dpd <= 30), F.greatest(dpd - 5, F.lit(0.0)) / 24.0)
             .when(dpd == 0, F.lit(0.0))
             .otherwise(F.least(dpd / 280.0, F.lit(1.0))))
    sv = delta * 0.6 + (v2 / 2.0) * 0.4
    first = {"dpd_band_position": band, "projected_dpd_next": F.greatest(F.lit(0.0), dpd + delta), "smooth_velocity": sv,
             "smooth_proj_dpd": F.greatest(F.lit(0.0), dpd + sv)}
    d = df.select(*[c for c in df.columns if c not in first], *[c.alias(n) for n, c in first.items()])
    flags = dpd_flags("double")
    names = ["proj_will_be_high", "proj_will_be_default", "proj_will_be_medium", "proj_will_be_low", "smooth_proj_high",
             "smooth_proj_default", "near_high_threshold", "near_default_threshold", "near_medium_threshold"]
    return d.select(*[c for c in d.columns if c not in names], *flags)


# 4 synthetic copies per High row, 5 % relative Gaussian noise.
AUG_MULTIPLIER = 4
NOISE_SIGMA = 0.05


def _row_hash(*parts):
    """md5 of the parts and the row's key, as hexadecimal text."""
    return F.md5(F.concat_ws("|", *parts, F.col("loan_id"), F.col("observation_month"),
                             F.col(ROW_SEQ).cast("string")).cast("binary"))


BLOCK_DIGITS = 4       # hexadecimal digits of a row's hash: at most 65,536 blocks


def ranked_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """``df`` with ``_rank``: the row's place (from 0) by the hash of its key. Ranks
    are places inside blocks of hashes plus the rows of the blocks before, so no
    task sorts more than a block; the table of blocks is bounded by its digits."""
    d = df.withColumn("_key", _row_hash(F.lit(str(seed))))
    d = d.withColumn("_block", F.substring("_key", 1, BLOCK_DIGITS))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy(F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_key")) - 1
    return (d.withColumn("_place", place).join(F.broadcast(blocks), F.col("_block") == F.col("_b"))
             .withColumn("_rank", F.col("_before") + F.col("_place")).drop("_key", "_block", "_b", "_before", "_place"))


def draw_ranks(spark: SparkSession, draws: int, n: int, seed: int = 42, salt: str = "draw") -> DataFrame:
    """``_draw`` (from 0) and the ``_rank`` below ``n`` that its hash falls on: draws with replacement."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col("id").cast("string")).cast("binary"))
    return spark.range(draws).select(
        F.col("id").alias("_draw"), (F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % F.lit(n)).alias("_rank"))


def draw_with_replacement(df: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """L4's draws: ``times`` x the rows of ``df``, each drawn from all rows alike by a
    hash of seed and draw number. ``df`` is read more than once: write it first."""
    ranked = ranked_rows(df, seed)
    n = df.count()
    if n == 0:
        return df.withColumn("_draw", F.lit(0).cast("bigint"))
    return ranked.join(draw_ranks(df.sparkSession, times * n, n, seed), "_rank").drop("_rank")


def _normals(seed: int, n: int) -> tuple[list, list]:
    """Columns of the digests (named) and ``n`` standard normal numbers from them
    (Box-Muller): four to a digest of seed and draw number, the same in every run
    and on every partitioning."""
    digests = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(f"noise{i}"), F.col("_draw").cast("string")).cast("binary"))
               .alias(f"_d{i}") for i in range(-(-n // 4))]

    def unit(i, at):
        return (F.conv(F.substring(f"_d{i}", at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    normals = []
    for i in range(len(digests)):
        for at in (1, 17):
            size, angle = F.sqrt(F.lit(-2.0) * F.log(unit(i, at))), unit(i, at + 8) * 6.283185307179586
            normals += [size * F.cos(angle), size * F.sin(angle)]
    return digests, normals[:n]


def augment_high(train: DataFrame, features: list[str], seed: int = 42,
                 copies: int = AUG_MULTIPLIER, target: str = "High",
                 label: str = "next_risk_state") -> DataFrame:
    """L4: ``copies`` x as many noisy rows as there are rows labelled ``target``,
    drawn from them with replacement.

    Each adds N(0, 0.05 * (|x| + 0.01)) to every feature (from a hash of seed and
    draw), clips at 0, clamps DPD into the band of the drawn row's current DPD
    (Medium copies also get delta = |delta| + 2), and recomputes the DPD-derived
    features. The target's rows are written once; draws meet them by rank.
    """
    base = write_stage(fill_features(train.filter(F.col(label) == target), features)
                       .withColumn("_cur", state_from_dpd(F.col("days_in_arrears"))), "augment")
    drawn = draw_with_replacement(base, copies, seed)
    digests, normals = _normals(seed, len(features))
    others = [c for c in base.columns if c not in features]
    noisy = drawn.select(*base.columns, *digests).select(
        *others, *[F.greatest(F.lit(0.0), F.col(f) + z * (NOISE_SIGMA * (F.abs(F.col(f)) + 0.01))).alias(f)
                   for f, z in zip(features, normals)])
    d, cur = F.col("days_in_arrears"), F.col("_cur")
    moved = {"days_in_arrears": F.when(cur == "High", clip(d, 31.0, 90.0)).when(cur == "Medium", clip(d, 22.0, 30.0))
                                 .when(cur == "Default", clip(d, 91.0, 300.0)).otherwise(clip(d, 0.0, 30.0)),
             "dpd_delta": F.when(cur == "Medium", F.abs(F.col("dpd_delta")) + 2.0).otherwise(F.col("dpd_delta"))}
    for f in ("dpd_delta", "dpd_velocity_2m"):
        if f not in noisy.columns:
            noisy = noisy.withColumn(f, F.lit(0.0))
    noisy = noisy.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in noisy.columns])
    out = recompute_dpd_features(noisy).withColumn(label, F.lit(target)).withColumn("synthetic", F.lit(True))
    return out.drop("_cur")


def append_synthetic(train: DataFrame, synthetic: DataFrame, features: list[str],
                     label: str = "next_risk_state") -> DataFrame:
    """Real + synthetic rows on the columns training needs."""
    cols = features + [label]
    real = fill_features(train, features).select(*cols).withColumn("synthetic", F.lit(False))
    return real.unionByName(synthetic.select(*cols, "synthetic"))


# ---------------------------------------------------------------------------
# Models
# ---------------------------------------------------------------------------

@dataclass
class RiskModel:
    kind: str
    features: list[str]
    models: list            # the fitted model: MLlib forest, boosted trees or coefficients
    scaling: DataFrame | None = None
    threshold: float = HIGH_RISK_THRESHOLD
    meta: dict = field(default_factory=dict)
    encodings: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def input_cols(self) -> list[str]:
        return [f + "_z" for f in self.features] if self.scaling is not None else list(self.features)


def _apply_scaling(df: DataFrame, scaling: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``<f>_z`` standardised columns using the one-row statistics table (a
    scalar subquery)."""
    j = df.withColumn("_st", scaling.select(F.struct("*").alias("_st")).scalar()).select("*", "_st.*")
    zs = []
    for f in features:
        sd = F.when(F.col(f"_s_{f}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{f}"))
        zs.append(((F.col(f) - F.col(f"_m_{f}")) / sd).alias(f + "_z"))
    return j.select(*df.columns, *zs)


def _assemble(df: DataFrame, model: RiskModel) -> DataFrame:
    if model.scaling is not None:
        df = _apply_scaling(df, model.scaling, model.features)
    return VectorAssembler(inputCols=model.input_cols, outputCol="_features").transform(df)


def _prepare(df: DataFrame, features: list[str], label: str = "next_risk_state",
             weight: str | None = "weight") -> DataFrame:
    d = with_label(fill_features(df, features), label)
    if weight and weight not in d.columns:
        d = class_weights(d, label, weight)
    return d


def training_table(train: DataFrame, features: list[str], label: str = "next_risk_state",
                   weight: str | None = "weight", written: bool = False) -> DataFrame:
    """The stage boundary before every fit: features, label and balanced weight,
    written once. Fits scan it again and again without the features' lineage.
    ``written``: ``train`` is a scan of a written table, so counting its classes
    needs no copy of it first."""
    d = _labelled(train, features, label, weight, written)
    return write_stage(d, "training") if weight else d


def _labelled(train: DataFrame, features: list[str], label: str, weight: str | None, written: bool) -> DataFrame:
    """The rows of :func:`training_table` before they are written."""
    d = with_label(fill_features(train, features), label).select(*features, "label")
    if not (written and weight):
        d = write_stage(d, "labelled")
    return class_weights(d, "label", weight).select(*features, "label", weight) if weight else d


def is_training_table(df: DataFrame, weight: str | None) -> bool:
    return "label" in df.columns and (not weight or weight in df.columns)


def fit_logistic(train: DataFrame, features: list[str], label: str = "next_risk_state",
                 C: float = 1.0, max_iter: int = 2000, tol: float = 1e-4,
                 weight: str | None = "weight", written: bool = False) -> RiskModel:
    """Multinomial logistic regression on standardised features with
    balanced class weights; ``C`` and ``tol`` as scikit-learn's (see
    :mod:`riskflow.operators.logistic`). The rows are formed once, into the fit's own
    blocks, and written in no other form: classes are counted in the blocks, so
    ``train`` need not be a written table (``written`` says nothing here)."""
    given = is_training_table(train, weight)
    d = train if given else with_label(fill_features(train, features), label).select(*features, "label")
    blocks = logistic.packed(d, list(features), weight if given else None)
    weights = logistic.label_weights(blocks) if weight and not given else None
    mean, std = logistic.statistics(blocks, len(features))
    names = [f"_m_{f}" for f in features] + [f"_s_{f}" for f in features]
    scaling = train.sparkSession.createDataFrame([(*mean, *std)], ", ".join(f"`{c}` double" for c in names))     # one row
    fitted = logistic.fit(blocks, list(features), mean, std, c=C, max_iter=max_iter, tol=tol, weights=weights)
    return RiskModel("logistic", list(features), [fitted], scaling)


# Fixed value: a table of more rows is dealt anew before a forest is grown on it.
EVEN_ROWS = 500_000


def even_tasks(df: DataFrame) -> DataFrame:
    """``df`` in tasks of like numbers of rows. Files are cut by bytes, and noisy rows
    take several times the bytes of others, so the task with the plainest rows holds
    several times the rows; every pass waits for it. The dealt rows are written once, as
    fits read them several times. Small tables stay as they are."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df if rows <= EVEN_ROWS else write_stage(df.repartition(-(-rows // (EVEN_ROWS * cores)) * cores), "even")


def fit_forest(train: DataFrame, features: list[str], label: str = "next_risk_state",
               num_trees: int = 300, max_depth: int = 30, seed: int = 42,
               weight: str | None = "weight") -> RiskModel:
    """Random forest with balanced weights (MLlib caps depth at 30). Its draws follow
    the rows' tasks, so those of a table beyond ``EVEN_ROWS`` follow the dealing."""
    shell = RiskModel("forest", list(features), [])
    d = train if is_training_table(train, weight) else _prepare(train, features, label, weight)
    d = even_tasks(_assemble(d, shell).select("_features", "label", *([weight] if weight else [])))
    rf = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol=weight,
                                numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                featureSubsetStrategy="sqrt")
    shell.models = [rf.fit(d)]
    return shell


def fit_boosted(train: DataFrame, features: list[str], label: str = "next_risk_state",
                rounds: int = 300, depth: int = 6, learning_rate: float = 0.1,
                subsample: float = 0.8, colsample: float = 0.8, bins: int = boosting.MOST_BINS,
                seed: int = 42, weight: str | None = "weight") -> RiskModel:
    """Gradient-boosted trees on the softmax loss, one tree per state and
    round (see :mod:`riskflow.operators.boosting`)."""
    d = train if is_training_table(train, weight) else training_table(train, features, label, weight)
    return RiskModel("boosted", list(features), [boosting.fit(
        d, list(features), rounds, depth, learning_rate, subsample, colsample, bins, seed=seed, weight=weight)])


def predict_batch(model: RiskModel, df: DataFrame) -> DataFrame:
    """Probabilities + pred/score/p_pred/is_worse (+ early-warning flag)
    on any feature table; the input columns pass through unchanged."""
    src = fill_features(df, model.features)
    cols = src.columns
    if model.kind == "logistic":
        return with_prediction_columns(logistic.probabilities(src, model.models[0], PROB_COLS)).withColumn(
            "early_warning_high", F.col("p_high") >= model.threshold)
    if model.kind == "boosted":
        return with_prediction_columns(boosting.probabilities(src, model.models[0], PROB_COLS)).withColumn(
            "early_warning_high", F.col("p_high") >= model.threshold)
    t = model.models[0].transform(_assemble(src, model))
    arr = vector_to_array("probability")
    out = t.select(*cols, *[arr[i].alias(c) for i, c in enumerate(PROB_COLS)])
    return with_prediction_columns(out).withColumn(
        "early_warning_high", F.col("p_high") >= model.threshold)


def predict_snapshot(model: RiskModel, snapshot: DataFrame, panel: DataFrame) -> DataFrame:
    """L11 from raw rows in one call: trajectory features of the snapshot's
    loans where the model lists any, the model's own encodings, prediction."""
    from riskflow.operators.features import TRAJECTORY_COLUMNS, trajectory_features
    df = snapshot
    if set(model.features) & set(TRAJECTORY_COLUMNS):
        key = ["loan_id", "observation_month", ROW_SEQ]
        df = df.drop(*[c for c in TRAJECTORY_COLUMNS if c in df.columns])
        history = panel.drop(*[c for c in TRAJECTORY_COLUMNS if c in panel.columns])
        history = history.join(df.select("loan_id").distinct(), "loan_id", "left_semi")
        found = trajectory_features(history).select(*key, *TRAJECTORY_COLUMNS)
        df = df.join(found, key, "left")
    return predict_batch(model, apply_encodings(df, model.encodings))


def predict_account(model: RiskModel, latest_row: DataFrame) -> DataFrame:
    """The same code path on a search's latest row, probabilities 4 dp."""
    p = predict_batch(model, latest_row)
    return p.select("loan_id", "pred", *[F.round(c, 4).alias(c) for c in PROB_COLS])


# ---------------------------------------------------------------------------
# Explanations
# ---------------------------------------------------------------------------

def linear_contributions(model: RiskModel, df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Exact per-feature contributions of the multinomial logistic model in
    logit space: w[c, j] * z_j with z the standardised feature (the training
    mean of z is 0, so this is the linear SHAP value). One row per
    (id, class, feature); the coefficient table is k x p rows, fixed by the model."""
    if model.kind != "logistic":
        raise ValueError("linear contributions need the logistic model")
    coef = model.models[0].coefficients
    wt = df.sparkSession.createDataFrame(
        [(STATES[c], f, float(coef[c][j])) for c in range(len(STATES)) for j, f in enumerate(model.features)],
        "class string, feature string, w double")
    d = _apply_scaling(fill_features(df, model.features).select(*id_cols, *model.features),
                       model.scaling, model.features)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"),
                                         F.col(f + "_z").alias("z")) for f in model.features])).alias("_c")
    long = d.select(*id_cols, pairs).select(*id_cols, "_c.*")
    j = long.join(F.broadcast(wt), "feature")
    return j.select(*id_cols, "class", "feature", "value", (F.col("w") * F.col("z")).alias("contribution"))


def feature_labels(df: DataFrame, feature_col: str = "feature", out: str = "feature_label") -> DataFrame:
    """Display label (default: the feature name) via a small literal map."""
    m = F.create_map(*[x for k, v in FEATURE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.coalesce(F.element_at(m, F.col(feature_col)), F.col(feature_col)))


def explain_top(contribs: DataFrame, id_cols: list[str], class_col: str = "pred", n: int = 5) -> DataFrame:
    """Top-n features by |contribution| for each row's own class (the
    predicted one by default); value 2 dp, contribution 4 dp, with labels."""
    w = Window.partitionBy(*id_cols).orderBy(F.abs("contribution").desc(), F.col("feature"))
    t = contribs.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    t = feature_labels(t)
    return t.select(*id_cols, F.col("_rk").alias("rank"), "feature", "feature_label",
                    F.round("value", 2).alias("value"), F.round("contribution", 4).alias("contribution"))


def driver_direction(df: DataFrame, pred_col: str = "pred") -> DataFrame:
    """Increasing / reducing risk, supports healthy state, minor factor."""
    risky = F.col(pred_col).isin("High", "Default")
    pushes = F.col("contribution") > 0
    return df.withColumn("direction", F.when(risky & pushes, "increasing risk")
                         .when(risky, "reducing risk")
                         .when(pushes, "supports healthy state").otherwise("minor factor"))


def global_importance(contribs: DataFrame, cls: str = "Default") -> DataFrame:
    """Mean |contribution| per feature for one class, 4 dp, descending."""
    g = contribs.filter(F.col("class") == cls).groupBy("feature") \
        .agg(F.round(F.avg(F.abs("contribution")), 4).alias("importance"))
    return feature_labels(g).orderBy(F.col("importance").desc(), F.col("feature"))


def top_drivers_text(contribs: DataFrame, id_cols: list[str], cls: str = "Default", n: int = 3) -> DataFrame:
    """The n strongest drivers of one class joined into ``a · b · c``."""
    c = contribs.filter(F.col("class") == cls)
    w = Window.partitionBy(*id_cols).orderBy(F.abs("contribution").desc(), F.col("feature"))
    t = feature_labels(c.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n))
    agg = t.groupBy(*id_cols).agg(F.sort_array(F.collect_list(F.struct("_rk", "feature_label"))).alias("_l"))
    return agg.select(*id_cols, F.concat_ws(" · ", F.transform("_l", lambda x: x["feature_label"]))
                      .alias("top_drivers"))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement, seeded: a top-n on a hash of the row's
    key, so the sample does not depend on partitioning."""
    return df.withColumn("_r", _row_hash(F.lit(str(seed)))).orderBy("_r", "loan_id").limit(n).drop("_r")


# ---------------------------------------------------------------------------
# Persistence
# ---------------------------------------------------------------------------

_MODEL_CLASSES = {
    "forest": "pyspark.ml.classification.RandomForestClassificationModel",
}


def save_model(model: RiskModel, path: str) -> None:
    """Fitted models, encodings, scaling row and metadata (kind, ordered
    features, threshold) under one folder."""
    spark = SparkSession.active()
    for i, m in enumerate(model.models):
        if model.kind == "logistic":
            logistic.to_table(m, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model_{i}")
        elif model.kind == "boosted":
            boosting.to_table(m, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model_{i}")
        else:
            m.write().overwrite().save(f"{path}/model_{i}")
    if model.scaling is not None:
        model.scaling.write.mode("overwrite").parquet(f"{path}/scaling")
    meta = {"kind": model.kind, "features": model.features, "threshold": model.threshold,
            "n_models": len(model.models), "has_scaling": model.scaling is not None}
    for c, table in model.encodings.items():
        table.write.mode("overwrite").parquet(f"{path}/encodings/{c}")
    meta["encodings"] = sorted(model.encodings)
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


def load_model(spark, path: str) -> RiskModel:
    import importlib
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["kind"] == "logistic":
        models = [logistic.from_table(spark.read.parquet(f"{path}/model_{i}")) for i in range(meta["n_models"])]
    elif meta["kind"] == "boosted":
        models = [boosting.from_table(spark.read.parquet(f"{path}/model_{i}"), meta["features"])
                  for i in range(meta["n_models"])]
    else:
        mod, cls = _MODEL_CLASSES[meta["kind"]].rsplit(".", 1)
        klass = getattr(importlib.import_module(mod), cls)
        models = [klass.load(f"{path}/model_{i}") for i in range(meta["n_models"])]
    scaling = spark.read.parquet(f"{path}/scaling") if meta["has_scaling"] else None
    encodings = {c: spark.read.parquet(f"{path}/encodings/{c}") for c in meta.get("encodings", [])}
    return RiskModel(meta["kind"], meta["features"], models, scaling, meta["threshold"], encodings=encodings)
