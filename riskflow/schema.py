"""Fixed schemas. The panel is read with an explicit schema, never inferred."""

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

PANEL_COLUMNS = [
    ("loan_id", _S), ("customer_id", _S), ("observation_month", _S),
    ("risk_state", _S), ("performance_class", _S),
    ("days_in_arrears", _D), ("instalments_in_arrears", _D),
    ("segment", _S), ("loan_type", _S), ("branch_name", _S), ("isic_industry_name", _S),
    ("disbursement_date", _S), ("loan_term_months", _D), ("number_instalments_paid", _D),
    ("disbursed_amount_lcy", _D), ("principal_balance", _D), ("principal_due", _D),
    ("penal_interest", _D), ("suspended_interest", _D), ("interest_due", _D),
    ("accrued_interest", _D), ("all_crb", _D), ("interest_rate", _D),
]

PANEL_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in PANEL_COLUMNS])
PANEL_NAMES = [n for n, _ in PANEL_COLUMNS]

# Ingestion order, used to break ties within (loan_id, observation_month).
ROW_SEQ = "row_seq"

CRITICAL_COLUMNS = ["customer_id", "loan_id", "observation_month",
                    "days_in_arrears", "risk_state", "performance_class"]
# Non-critical fills applied by cleaning (fixed values).
FILL_UNKNOWN = ["segment", "isic_industry_name"]
FILL_ZERO = ["penal_interest", "suspended_interest", "principal_due",
             "accrued_interest", "interest_due"]
