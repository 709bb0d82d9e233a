"""Registered queries of the corpus operators and their DuckDB statements.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskflow.llm import (
    exact_dedup, fill_middle, fingerprint, html_extract, language_id, lm_scoring, mixing, order_minhash, personal_data,
    secret_scan, sentencepiece_codec, source_divergence, warc)
from riskflow.llm.common import documents, labels, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(documents(spark, sf_dir))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(text, '')) AS tie
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
                WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, 2 * words AS cap,
        ((sum(words) OVER ())::DOUBLE * 1.5
          - coalesce(sum(2 * words) OVER (ORDER BY (2 * words) / weight, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY (2 * words) / weight, source ASC NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w),
f AS (SELECT *, (SELECT x.level FROM l x WHERE x.level * x.weight <= x.cap
                 ORDER BY (2 * x.words) / x.weight, x.source ASC NULLS LAST LIMIT 1) AS water FROM l),
t AS (SELECT source, words, coalesce(least(cap::DOUBLE, water * weight), cap::DOUBLE) AS target,
        (('0x' || substr(md5('mix:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT)::DOUBLE
          / 4294967296.0::DOUBLE AS u
      FROM f),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size,
        substr(coalesce(md5(doc_id::VARCHAR), tie), 1, 3), doc_id ASC NULLS LAST, tie)::DOUBLE AS rnk FROM d),
j AS (SELECT r.doc_id, r.size, t.words, t.target, t.u, r.rnk,
        CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target,
  ((floor(rate * rnk + u) - floor(rate * (rnk - 1) + u)) * size)::BIGINT AS taken
FROM j
"""


@query("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark, sf_dir):
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


@query("op6_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, strlen(html) AS n FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
""")
def op6_warc(spark, sf_dir):
    return warc.roundtrip(pages(spark, sf_dir)).drop("bundle")


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(documents(spark, sf_dir))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


@query("op5_html_extract")
def op5_html_extract(spark, sf_dir):
    return html_extract.extract_pages(pages(spark, sf_dir))


@query("op10_fingerprint")
def op10_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


@query("op7_order_minhash")
def op7_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicate_classes(documents(spark, sf_dir))


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(documents(spark, sf_dir), lm_scoring.target_ids(labels(spark, sf_dir)))


@query("op11_source_divergence", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words,
    row_number() OVER () AS row
  FROM documents),
t AS (SELECT row, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v.v) AS p FROM grid JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
used AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM used))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
""")
def op11_source_divergence(spark, sf_dir):
    return source_divergence.audit(documents(spark, sf_dir))


@query("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    return personal_data.digests(personal_data.find_personal_data(documents(spark, sf_dir)))


@query("op13_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2, ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 AS spm,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM d),
s AS (SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix,
    array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN NOT plain THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
""")
def op13_fill_middle(spark, sf_dir):
    return fill_middle.digests(fill_middle.fill_in_middle(documents(spark, sf_dir)))
