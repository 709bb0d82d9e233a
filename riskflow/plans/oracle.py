"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

``BASE`` rebuilds the same panel, verified panel, transition pairs and the
long portfolio matrix from the raw tables with the same formulas as the
Spark plan. ``with_base(body_ctes, select)`` prefixes a query with it.
Every constant is written as a double where Spark uses a double.
"""

from __future__ import annotations

STATE_VALUES = "(VALUES ('Low', 0), ('Medium', 1), ('High', 2), ('Default', 3)) AS t(state, idx)"

PANEL_SQL = """
li_m AS (
  SELECT l_partkey AS k, strftime(l_shipdate, '%Y-%m') AS observation_month,
         count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS r,
         count(*) FILTER (WHERE l_returnflag = 'N') AS a,
         CAST(sum(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY 1, 2),
s1 AS (
  SELECT *, CASE WHEN r > a THEN 1 WHEN r < a THEN -1 ELSE 0 END AS step FROM li_m),
s2 AS (
  SELECT *, CAST(sum(step) OVER w AS BIGINT) AS cs,
         CAST(sum(CASE WHEN step <= 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS paid,
         min(observation_month) OVER (PARTITION BY k) AS first_month
  FROM s1 WINDOW w AS (PARTITION BY k ORDER BY observation_month
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s3 AS (
  SELECT *, cs - least(0, min(cs) OVER w) AS wv
  FROM s2 WINDOW w AS (PARTITION BY k ORDER BY observation_month
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s4 AS (
  SELECT *, max(wv) OVER w AS mx
  FROM s3 WINDOW w AS (PARTITION BY k ORDER BY observation_month
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s5 AS (
  SELECT *, CAST(CASE WHEN mx >= 4 THEN 91 + q % 120 WHEN wv = 0 THEN 0
                      WHEN wv = 1 THEN 1 + q % 30 ELSE 31 + q % 60 END AS DOUBLE) AS dpd
  FROM s4),
panel AS (
  SELECT 'LN' || CASE WHEN k < 100000 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END AS loan_id,
         'ANON_' || CAST(k % 997 AS VARCHAR) AS customer_id,
         observation_month,
         CASE WHEN dpd = 0 THEN 'Low' WHEN dpd >= 1 AND dpd <= 30 THEN 'Medium'
              WHEN dpd >= 31 AND dpd <= 90 THEN 'High' WHEN dpd > 90 THEN 'Default'
              ELSE 'Unknown' END AS risk_state,
         CASE WHEN dpd = 0 THEN 'Low' WHEN dpd >= 1 AND dpd <= 30 THEN 'Medium'
              WHEN dpd >= 31 AND dpd <= 90 THEN 'High' WHEN dpd > 90 THEN 'Default'
              ELSE 'Unknown' END AS performance_class,
         dpd AS days_in_arrears,
         CAST(wv AS DOUBLE) AS instalments_in_arrears,
         CASE WHEN p_size % 20 = 0 THEN 'CORPORATE' WHEN p_size % 20 BETWEEN 1 AND 2 THEN 'AGRICULTURE'
              WHEN p_size % 20 BETWEEN 3 AND 5 THEN 'SME' WHEN p_size % 20 = 6 THEN NULL
              ELSE 'RETAIL' END AS segment,
         p_brand AS loan_type,
         'BR' || CAST(k % 7 AS VARCHAR) AS branch_name,
         p_type AS isic_industry_name,
         CASE WHEN k % 101 = 0 THEN '2024131x'
              ELSE strftime(CAST(strptime(first_month || '-01', '%Y-%m-%d') AS DATE)
                            - to_months(CAST(k % 24 AS INTEGER)), '%Y%m%d') END AS disbursement_date,
         CASE WHEN k % 211 = 0 THEN 0.0 ELSE 12.0 + 12.0 * (k % 8) END AS loan_term_months,
         CAST(paid AS DOUBLE) AS number_instalments_paid,
         p_retailprice * CAST(1000.0 AS DOUBLE) AS disbursed_amount_lcy,
         p_retailprice * CAST(1000.0 AS DOUBLE)
           * (CAST(1.0 AS DOUBLE) - least(CAST(1.0 AS DOUBLE), CAST(paid AS DOUBLE) / CAST(60.0 AS DOUBLE))) AS principal_balance,
         CAST(q AS DOUBLE) * 100.0 AS principal_due,
         CASE WHEN dpd > 0 THEN dpd * 5.0 END AS penal_interest,
         CASE WHEN dpd > 90 THEN CAST(q AS DOUBLE) * 7.0 END AS suspended_interest,
         CAST(q AS DOUBLE) * 10.0 AS interest_due,
         CAST(q AS DOUBLE) * 3.0 AS accrued_interest,
         CAST(n AS DOUBLE) * 1000.0 AS all_crb,
         CAST(12 + k % 10 AS DOUBLE) AS interest_rate,
         CAST(0 AS BIGINT) AS row_seq
  FROM s5 JOIN part ON p_partkey = k)"""

CODE = ("CASE {c} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 "
        "WHEN 'Default' THEN 3 END")

VERIFIED_SQL = """
cleaned AS (
  SELECT * REPLACE (coalesce(segment, 'UNKNOWN') AS segment,
                    coalesce(isic_industry_name, 'UNKNOWN') AS isic_industry_name,
                    coalesce(penal_interest, 0.0) AS penal_interest,
                    coalesce(suspended_interest, 0.0) AS suspended_interest,
                    coalesce(principal_due, 0.0) AS principal_due,
                    coalesce(accrued_interest, 0.0) AS accrued_interest,
                    coalesce(interest_due, 0.0) AS interest_due)
  FROM panel
  WHERE customer_id IS NOT NULL AND loan_id IS NOT NULL AND observation_month IS NOT NULL
    AND days_in_arrears IS NOT NULL AND risk_state IS NOT NULL AND performance_class IS NOT NULL),
verified AS (
  SELECT * REPLACE (CAST(try_strptime(substr(disbursement_date, 1, 8), '%Y%m%d') AS DATE) AS disbursement_date),
         CAST(""" + CODE.format(c="risk_state") + """ AS INTEGER) AS risk_state_code,
         CASE WHEN disbursed_amount_lcy > 0 THEN
              CASE WHEN 1.0 - principal_balance / disbursed_amount_lcy < 0 THEN 0.0
                   WHEN 1.0 - principal_balance / disbursed_amount_lcy > 1 THEN 1.0
                   ELSE 1.0 - principal_balance / disbursed_amount_lcy END
              ELSE 0.0 END AS repayment_ratio,
         CAST(strptime(observation_month || '-01', '%Y-%m-%d') AS DATE) AS obs_date,
         CAST(CASE WHEN md < 0 THEN 0 ELSE md END AS INTEGER) AS loan_age_months,
         CASE WHEN loan_term_months > 0 THEN
              CASE WHEN instalments_in_arrears / loan_term_months < 0 THEN 0.0
                   WHEN instalments_in_arrears / loan_term_months > 1 THEN 1.0
                   ELSE instalments_in_arrears / loan_term_months END
              ELSE 0.0 END AS arrears_ratio,
         lead(risk_state) OVER w AS next_risk_state,
         CAST(lead(""" + CODE.format(c="risk_state") + """) OVER w AS INTEGER) AS next_risk_state_code
  FROM (SELECT *,
               (year(CAST(strptime(observation_month || '-01', '%Y-%m-%d') AS DATE))
                  - year(CAST(try_strptime(substr(disbursement_date, 1, 8), '%Y%m%d') AS DATE))) * 12
               + (month(CAST(strptime(observation_month || '-01', '%Y-%m-%d') AS DATE))
                  - month(CAST(try_strptime(substr(disbursement_date, 1, 8), '%Y%m%d') AS DATE))) AS md
        FROM cleaned) c
  WINDOW w AS (PARTITION BY loan_id ORDER BY observation_month, row_seq)),
verified_out AS (SELECT * EXCLUDE (md) FROM verified),
pairs AS (SELECT * FROM verified_out WHERE next_risk_state IS NOT NULL)"""

MATRIX_SQL = """
st AS (SELECT * FROM """ + STATE_VALUES + """),
grid AS (SELECT a.state AS from_state, a.idx AS from_idx, b.state AS to_state, b.idx AS to_idx
         FROM st a, st b),
pc AS (SELECT risk_state, next_risk_state, count(*) AS n FROM pairs GROUP BY 1, 2),
cnt AS (
  SELECT g.from_state, g.to_state, g.from_idx, g.to_idx, CAST(coalesce(pc.n, 0) AS BIGINT) AS n_pairs
  FROM grid g LEFT JOIN pc ON pc.risk_state = g.from_state AND pc.next_risk_state = g.to_state),
pm AS (
  SELECT *, CASE WHEN sum(n_pairs) OVER (PARTITION BY from_state) = 0 THEN NULL
                 ELSE n_pairs / CAST(sum(n_pairs) OVER (PARTITION BY from_state) AS DOUBLE) END AS p
  FROM cnt)"""

BASE = PANEL_SQL + "," + VERIFIED_SQL + "," + MATRIX_SQL


def with_base(ctes: str, select: str) -> str:
    """``WITH RECURSIVE <base>, <ctes> <select>``."""
    extra = ("," + ctes) if ctes.strip() else ""
    return "WITH RECURSIVE " + BASE + extra + "\n" + select


# P^h for h = 1..H by recursion (h = 0 added as the identity where needed).
def power_cte(max_h: int, name: str = "pw", src: str = "pm") -> str:
    return f"""
{name}(h, i, j, p) AS (
  SELECT 1, from_idx, to_idx, p FROM {src}
  UNION ALL
  SELECT {name}.h + 1, {name}.i, {src}.to_idx, sum({name}.p * {src}.p)
  FROM {name} JOIN {src} ON {name}.j = {src}.from_idx
  WHERE {name}.h < {max_h}
  GROUP BY {name}.h + 1, {name}.i, {src}.to_idx)"""


STATE_NAME = "CASE {c} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Default' END"
