"""Column-expression building blocks (all JVM-side, codegen-friendly)."""

from riskflow.functions.columns import *  # noqa: F401,F403
from riskflow.functions.matrix import *  # noqa: F401,F403
