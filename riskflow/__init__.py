"""riskflow: risk-transition analytics for monthly account panels, on Spark.

Every public operator is a lazy ``DataFrame -> DataFrame`` function. Nothing
is collected to the driver: transition matrices travel as small packed
``array<array<double>>`` rows and are joined back where needed.
"""

from riskflow.states import STATES, DEFAULT_STATE

__all__ = ["STATES", "DEFAULT_STATE"]
__version__ = "0.1.0"
