"""The ordered risk-state space.

States are a parameter everywhere (``states=STATES``); the order of the list
is the code of each state (Low=0 ... Default=3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's state model.
STATES = ["Low", "Medium", "High", "Default"]
DEFAULT_STATE = "Default"
# Days-past-due band edges: Low = 0, Medium = 1..30, High = 31..90, Default > 90.
DPD_MEDIUM_MIN = 1
DPD_MEDIUM_MAX = 30
DPD_HIGH_MIN = 31
DPD_HIGH_MAX = 90
# The five-state artifact's state list (alphabetical, as the artifact stores it).
FIVE_STATES = ["Default", "High-Doubtful", "High-SubStd", "Low", "Medium"]
# Absorbing threshold on the diagonal of P.
ABSORBING_THRESHOLD = 0.95


def state_code(col: Column | str, states: list[str] = STATES) -> Column:
    """Map a state label to its index in ``states``; unknown or null -> null."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, s in enumerate(states):
        expr = F.when(c == s, F.lit(i)) if expr is None else expr.when(c == s, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))
