"""Markov algebra over tables of matrices.

Input is a packed matrix table ``(by..., P)``: one row for the whole
portfolio, one per segment or stage otherwise. Every operator is a row-wise
expression on that table (executors do the algebra) or a join of it back to
accounts. Tables with one row per account are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.matrix import (identity_like, mat_get, mat_has_null, mat_inverse,
                                       matmul, matpow, powers_upto, vecmat)
from riskflow.states import ABSORBING_THRESHOLD, DEFAULT_STATE, STATES
from riskflow.operators.transitions import to_long


def _labels(states):
    return F.array(*[F.lit(s) for s in states])


# Fixed value: powers are cached up to 60 months; longer terms use P^60.
POWER_CAP = 60


def matrix_power(packed: DataFrame, horizons: list[int], by: list[str] | None = None,
                 states: list[str] = STATES, digits: int | None = None) -> DataFrame:
    """M1: long P^h for each h in ``horizons`` (h = 0 is the identity)."""
    by = list(by or [])
    k = len(states)
    hs = F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon")
    t = packed.select(*by, "P", hs).select(*by, "horizon",
                                           matpow(F.col("P"), F.col("horizon"), k).alias("Pn"))
    long = to_long(t, by + ["horizon"], states, matrix_col="Pn", with_counts=False)
    if digits is not None:
        long = long.withColumn("p", F.round("p", digits))
    return long


def forecast(packed: DataFrame, horizon: int = 6, by: list[str] | None = None,
             states: list[str] = STATES) -> DataFrame:
    """M2: P^h rounded to 4 dp, plus the High->Default cell on every row."""
    by = list(by or [])
    k = len(states)
    t = packed.select(*by, F.lit(int(horizon)).alias("horizon"),
                      matpow(F.col("P"), horizon, k).alias("Pn"))
    hd = F.round(mat_get(F.col("Pn"), states.index("High"), states.index(DEFAULT_STATE)), 4)
    t = t.withColumn("high_to_default", hd)
    long = to_long(t, by + ["horizon", "high_to_default"], states, matrix_col="Pn",
                   with_counts=False)
    return long.withColumn("p", F.round("p", 4))


def snapshot_counts(panel: DataFrame, month=None, segment: str | None = "All Segments",
                    states: list[str] = STATES, state_col: str = "risk_state") -> DataFrame:
    """Counts per state of one month (latest when ``month`` is None): one row
    ``(total, counts array<bigint>)`` from a single global aggregate."""
    from riskflow.operators.overview import latest_snapshot, snapshot
    d = latest_snapshot(panel) if month is None else snapshot(panel, month, segment)
    if month is None and segment not in (None, "All Segments"):
        d = d.filter(F.col("segment") == segment)
    s = F.col(state_col)
    return d.agg(F.count(F.lit(1)).alias("total"),
                 F.array(*[F.count_if(s == st) for st in states]).alias("counts"))


def _pi0(counts_row):
    tot = F.aggregate(counts_row, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(counts_row, lambda x: x.cast("double") / tot.cast("double"))


def _with_matrix(dist: DataFrame, packed: DataFrame) -> DataFrame:
    """Attach the single portfolio matrix (a scalar subquery) to the snapshot row."""
    return dist.withColumn("P", packed.select("P").scalar())


def portfolio_evolution(panel: DataFrame, packed: DataFrame, month=None,
                        segment: str | None = "All Segments", horizon: int = 6,
                        states: list[str] = STATES, scale: float = 100.0,
                        digits: int = 2) -> DataFrame:
    """M3: pi0 . P^n for n = 0..horizon (x100, 2 dp by default); an empty
    snapshot gives no rows. The vector is pushed one step per month (O(h))."""
    k = len(states)
    dist = snapshot_counts(panel, month, segment, states).filter(F.col("total") > 0)
    j = _with_matrix(dist, packed)
    init = F.struct(_pi0(F.col("counts")).alias("v"),
                    F.array(_pi0(F.col("counts"))).alias("acc"))
    traj = F.aggregate(F.array_repeat(F.lit(0), horizon), init,
                       lambda s, _x: F.struct(vecmat(s["v"], F.col("P"), k).alias("v"),
                                              F.concat(s["acc"], F.array(vecmat(s["v"], F.col("P"), k)))
                                              .alias("acc")))["acc"]
    t = j.select(F.posexplode(traj).alias("horizon_months", "pi"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")
    return t.select("horizon_months", "pi", cells).select(
        "horizon_months", F.element_at(_labels(states), F.col("_i") + 1).alias("state"),
        F.round(F.get(F.col("pi"), F.col("_i")) * scale, digits).alias("pct"))


def portfolio_forecast_table(panel: DataFrame, packed: DataFrame, month=None,
                             horizons=(0, 1, 3, 6), states: list[str] = STATES) -> DataFrame:
    """M4: shares at the given horizons, one column per state, 6 dp."""
    ev = portfolio_evolution(panel, packed, month, None, max(horizons), states, 1.0, 6)
    ev = ev.filter(F.col("horizon_months").isin(list(horizons)))
    return ev.groupBy("horizon_months").pivot("state", states).agg(F.first("pct"))


def horizon_default(packed: DataFrame, horizons=(1, 3, 6), by: list[str] | None = None,
                    states: list[str] = STATES, digits: int = 6) -> DataFrame:
    """M5: P^h[s, Default] per state and horizon."""
    long = matrix_power(packed, list(horizons), by, states)
    return long.filter(F.col("to_state") == DEFAULT_STATE).select(
        *(by or []), "horizon", F.col("from_state").alias("state"),
        F.round("p", digits).alias("p_default"))


def power_table(packed: DataFrame, n_max: int = POWER_CAP, by: list[str] | None = None,
                states: list[str] = STATES) -> DataFrame:
    """M7: ``(by..., n, from_state, to_state, p)`` for n = 1..n_max; k*k*n_max
    rows per group, a size fixed by the parameters."""
    by = list(by or [])
    k = len(states)
    t = packed.select(*by, F.posexplode(powers_upto(F.col("P"), n_max, k)).alias("_n0", "Pn"))
    t = t.withColumn("n", F.col("_n0") + 1).drop("_n0")
    return to_long(t, by + ["n"], states, matrix_col="Pn", with_counts=False)


def default_curve(packed: DataFrame, n_max: int = POWER_CAP, by: list[str] | None = None,
                  states: list[str] = STATES, digits: int = 6) -> DataFrame:
    """M6: P^n[s, Default] for n = 1..n_max and every transient state."""
    pt = power_table(packed, n_max, by, states)
    return pt.filter((F.col("to_state") == DEFAULT_STATE) & (F.col("from_state") != DEFAULT_STATE)) \
             .select(*(by or []), "n", F.col("from_state").alias("state"),
                     F.round("p", digits).alias("p_default"))


def within_term_default_prob(accounts: DataFrame, packed: DataFrame, cap: int = POWER_CAP,
                             states: list[str] = STATES, out: str = "within_term_default_prob"
                             ) -> DataFrame:
    """P^min(remaining, cap)[state, Default] per account; unknown
    state -> null. The lookup side has k*cap rows (bounded by the
    parameters), so it is broadcast to the account table."""
    pt = power_table(packed, cap, None, states).filter(F.col("to_state") == DEFAULT_STATE) \
        .select(F.col("from_state").alias("_s"), F.col("n").alias("_n"), F.col("p").alias(out))
    acc = accounts.withColumn("_n", F.least(F.col("remaining_months"), F.lit(cap)))
    j = acc.join(F.broadcast(pt), (acc["risk_state"] == pt["_s"]) & (acc["_n"] == pt["_n"]), "left")
    return j.drop("_s", "_n")


def horizon_risk_lookup(accounts: DataFrame, packed: DataFrame, horizon: int = 1,
                        states: list[str] = STATES, unknown: float | None = 0.0,
                        out: str = "horizon_risk") -> DataFrame:
    """P^h[s, High] + P^h[s, Default]; an unknown state gives ``unknown``."""
    long = matrix_power(packed, [horizon], None, states)
    look = long.groupBy(F.col("from_state").alias("_s")).agg(
        F.sum(F.when(F.col("to_state").isin("High", DEFAULT_STATE), F.col("p"))).alias(out))
    j = accounts.join(F.broadcast(look), accounts["risk_state"] == look["_s"], "left").drop("_s")
    if unknown is not None:
        j = j.withColumn(out, F.coalesce(F.col(out), F.lit(float(unknown))))
    return j


# ---------------------------------------------------------------------------
# Absorbing chain (Layer 3)
# ---------------------------------------------------------------------------

def absorbing_parts(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                    threshold: float = ABSORBING_THRESHOLD,
                    absorbing: list[str] | None = None) -> DataFrame:
    """M9 + M11-M14 in one projection: transient/absorbing index sets, Q, R,
    N = (I-Q)^-1, B = N.R, t = N.1, singular flag. The absorbing states are the
    named ones, or else those whose diagonal reaches the threshold."""
    by = list(by or [])
    k = len(states)
    P = F.col("P")
    idx = F.sequence(F.lit(0), F.lit(k - 1))
    if absorbing is None:
        t_idx = F.filter(idx, lambda i: mat_get(P, i, i) < threshold)
        a_idx = F.filter(idx, lambda i: mat_get(P, i, i) >= threshold)
    else:
        t_idx = F.array(*[F.lit(i) for i, s in enumerate(states) if s not in absorbing])
        a_idx = F.array(*[F.lit(i) for i, s in enumerate(states) if s in absorbing])
    base = packed.select(*by, "P", t_idx.alias("t_idx"), a_idx.alias("a_idx"))
    Q = F.transform(F.col("t_idx"), lambda i: F.transform(F.col("t_idx"), lambda j: mat_get(P, i, j)))
    R = F.transform(F.col("t_idx"), lambda i: F.transform(F.col("a_idx"), lambda j: mat_get(P, i, j)))
    base = base.select("*", Q.alias("Q"), R.alias("R"))
    i_minus_q = F.transform(F.col("Q"), lambda row, i: F.transform(
        row, lambda x, j: F.when(i == j, F.lit(1.0) - x).otherwise(-x)))
    base = base.withColumn("N", mat_inverse(i_minus_q))
    base = base.withColumn("singular", mat_has_null(F.col("N")))
    base = base.withColumn("B", F.when(F.size("a_idx") > 0, matmul(F.col("N"), F.col("R"))))
    base = base.withColumn("t", F.transform(
        F.col("N"), lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x)))
    return base


def classify_states(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                    threshold: float = ABSORBING_THRESHOLD) -> DataFrame:
    """M9: self-transition per state and whether it is absorbing."""
    by = list(by or [])
    k = len(states)
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")
    t = packed.select(*by, "P", i)
    selfp = mat_get(F.col("P"), F.col("_i"), F.col("_i"))
    return t.select(*by, F.element_at(_labels(states), F.col("_i") + 1).alias("state"),
                    F.round(selfp, 6).alias("self_transition"),
                    (selfp >= threshold).alias("absorbing"))


# Reachability uses P^100 and a 0.001 floor.
REACH_POWER = 100
REACH_FLOOR = 0.001


def reachability(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                 threshold: float = ABSORBING_THRESHOLD) -> DataFrame:
    """P^100[i, Default] per state, whether it clears 0.001, and whether
    every transient state does (the chain is a valid absorbing chain)."""
    by = list(by or [])
    k = len(states)
    d = states.index(DEFAULT_STATE)
    t = packed.select(*by, "P", matpow(F.col("P"), REACH_POWER, k).alias("Pbig"))
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")
    t = t.select(*by, "P", "Pbig", i)
    prob = mat_get(F.col("Pbig"), F.col("_i"), F.lit(d))
    transient = mat_get(F.col("P"), F.col("_i"), F.col("_i")) < threshold
    out = t.select(*by, F.element_at(_labels(states), F.col("_i") + 1).alias("state"),
                   F.round(prob, 6).alias("p_reach_default"),
                   (prob > REACH_FLOOR).alias("can_reach"), transient.alias("transient"))
    from pyspark.sql import Window
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ok = F.min(F.when(F.col("transient"), F.col("can_reach").cast("int"))).over(w)
    return out.withColumn("all_transient_reach", F.coalesce(ok, F.lit(1)) == 1)


def _explode_named(parts: DataFrame, by, mat: str, rows_idx: str, cols_idx: str,
                   states, value: str) -> DataFrame:
    lab = _labels(states)
    t = parts.select(*by, mat, rows_idx, cols_idx,
                     F.posexplode(F.col(mat)).alias("_i", "_row"))
    t = t.select(*by, rows_idx, cols_idx, "_i", F.posexplode("_row").alias("_j", "_v"))
    return t.select(*by,
                    F.element_at(lab, F.get(F.col(rows_idx), F.col("_i")) + 1).alias("from_state"),
                    F.element_at(lab, F.get(F.col(cols_idx), F.col("_j")) + 1).alias("to_state"),
                    F.col("_v").alias(value))


def canonical_form(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                   threshold: float = ABSORBING_THRESHOLD,
                   absorbing: list[str] | None = None) -> DataFrame:
    """Q and R cells in one long table with a ``block`` column."""
    by = list(by or [])
    parts = absorbing_parts(packed, by, states, threshold, absorbing)
    q = _explode_named(parts, by, "Q", "t_idx", "t_idx", states, "p").withColumn("block", F.lit("Q"))
    r = _explode_named(parts, by, "R", "t_idx", "a_idx", states, "p").withColumn("block", F.lit("R"))
    return q.unionByName(r)


def fundamental_matrix(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                       threshold: float = ABSORBING_THRESHOLD,
                       absorbing: list[str] | None = None, digits: int = 6) -> DataFrame:
    """N = (I - Q)^-1 cells (expected visits); a singular I-Q gives nulls."""
    by = list(by or [])
    parts = absorbing_parts(packed, by, states, threshold, absorbing)
    n = _explode_named(parts, by, "N", "t_idx", "t_idx", states, "n_visits")
    return n.withColumn("n_visits", F.round("n_visits", digits))


def time_to_absorption(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                       threshold: float = ABSORBING_THRESHOLD,
                       absorbing: list[str] | None = None) -> DataFrame:
    """M13 + M14: absorption probability into Default (B = N.R), expected
    months (row sums of N) and years, per transient state (6 dp / 2 dp / 2 dp)."""
    by = list(by or [])
    parts = absorbing_parts(packed, by, states, threshold, absorbing)
    d = states.index(DEFAULT_STATE)
    lab = _labels(states)
    t = parts.select(*by, "t_idx", "a_idx", "B", "t",
                     F.posexplode("t_idx").alias("_i", "_state_idx"))
    pos_d = F.array_position(F.col("a_idx"), F.lit(d)).cast("int")
    bprob = F.when(pos_d > 0, F.get(F.get(F.col("B"), F.col("_i")), pos_d - 1))
    months = F.get(F.col("t"), F.col("_i"))
    return t.select(*by, F.element_at(lab, F.col("_state_idx") + 1).alias("risk_state"),
                    F.round(bprob, 6).alias("absorption_probability"),
                    F.round(months, 2).alias("expected_months_to_default"),
                    F.round(months / 12.0, 2).alias("expected_years_to_default"))


def absorption_summary(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                       absorbing: tuple[str, ...] = (DEFAULT_STATE,)) -> DataFrame:
    """Per transient state probability (4 dp), months and years
    (1 dp), the expected visits to each transient state (``visits_<state>``, 4 dp)
    and the Default self-transition (4 dp), recomputed from P. The absorbing
    states are named: a state that rarely moves stays transient."""
    by = list(by or [])
    parts = absorbing_parts(packed, by, states, absorbing=list(absorbing))
    d = states.index(DEFAULT_STATE)
    lab = _labels(states)
    names = [s for s in states if s not in absorbing]
    t = parts.select(*by, "P", "a_idx", "B", "t", "N", F.posexplode("t_idx").alias("_i", "_state_idx"))
    pos_d = F.array_position(F.col("a_idx"), F.lit(d)).cast("int")
    bprob = F.when(pos_d > 0, F.get(F.get(F.col("B"), F.col("_i")), pos_d - 1))
    months = F.get(F.col("t"), F.col("_i"))
    visits = F.get(F.col("N"), F.col("_i"))
    return t.select(*by, F.element_at(lab, F.col("_state_idx") + 1).alias("state"),
                    F.round(bprob, 4).alias("probability"),
                    F.round(months, 1).alias("months"),
                    F.round(months / 12.0, 1).alias("years"),
                    *[F.round(F.get(visits, F.lit(k)), 4).alias(f"visits_{s.lower()}") for k, s in enumerate(names)],
                    F.round(mat_get(F.col("P"), d, d), 4).alias("default_self_transition"))


# The within-term vs infinite-horizon comparison grid.
COMPARE_HORIZONS = [3, 6, 12, 24, 36]


def within_vs_infinite(packed: DataFrame, states: list[str] = STATES,
                       horizons=COMPARE_HORIZONS) -> DataFrame:
    """Transient state x horizon: P^h[s, Default] next to the long-run
    absorption probability of s (null when s is not transient)."""
    within = horizon_default(packed, horizons, None, states, digits=6) \
        .filter(F.col("state") != DEFAULT_STATE)
    inf = time_to_absorption(packed, None, states).select(
        F.col("risk_state").alias("state"), F.col("absorption_probability").alias("infinite_horizon"))
    return within.join(F.broadcast(inf), "state", "left").select(
        "state", F.col("horizon").alias("remaining"), F.col("p_default").alias("within_term"),
        "infinite_horizon")


# Per-state intervention urgency text of Layer 3.
INTERVENTION_URGENCY = [("Low", "Low"), ("Medium", "Medium"), ("High", "HIGH")]


def intervention_urgency(df: DataFrame, state_col: str = "risk_state") -> DataFrame:
    """Literal map of transient state to urgency."""
    expr = None
    for s, u in INTERVENTION_URGENCY:
        c = F.col(state_col) == s
        expr = F.when(c, F.lit(u)) if expr is None else expr.when(c, F.lit(u))
    return df.withColumn("intervention_urgency", expr)


def matrix_checks(packed: DataFrame, by: list[str] | None = None, states: list[str] = STATES,
                  tol: float = 0.001) -> DataFrame:
    """V13-V16 per matrix: row sums within tol of 1, Default self >= 0.95,
    no negative cells, Q + R rows sum to 1."""
    by = list(by or [])
    d = states.index(DEFAULT_STATE)
    P = F.col("P")
    rs = F.transform(P, lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x))
    parts = absorbing_parts(packed, by, states)
    qr = F.transform(F.arrays_zip(F.col("Q"), F.col("R")), lambda z: F.aggregate(
        F.concat(z["Q"], z["R"]), F.lit(0.0), lambda a, x: a + x))
    return parts.select(
        *by,
        F.forall(rs, lambda s: F.abs(s - 1.0) <= tol).alias("rows_sum_to_one"),
        (mat_get(P, d, d) >= ABSORBING_THRESHOLD).alias("default_absorbing"),
        F.forall(F.flatten(P), lambda x: x >= 0).alias("non_negative"),
        F.forall(qr, lambda s: F.abs(s - 1.0) <= tol).alias("q_plus_r_is_one"),
    )
