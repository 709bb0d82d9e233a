import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from riskflow.llm import mixing
from riskflow.llm.queries import ORACLE
from tests.llm.helpers import DOC_SCHEMA, empty, frame, plain


def _oracle(df):
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841  duckdb reads it by name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    return duckdb.sql(ORACLE["op3_mix_sources"]).fetchall()


def _same(df):
    got = plain(mixing.plan_mix(df), "doc_id", "size", "source_size", "target", "taken")
    want = sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in _oracle(df)), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and a[4] == b[4]
    return got


def test_plan_matches_sql_on_awkward_rows(spark):
    _same(frame(spark))
    assert mixing.plan_mix(empty(spark)).count() == 0


def test_targets_and_bounds(spark):
    r, rows = random.Random(3), []
    for k in range(2500):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        rows.append((k, " ".join(["w"] * r.choice([0, 1, 5, 40, 40, 40, 300])), None, source, None))
    got = _same(spark.createDataFrame(rows, DOC_SCHEMA))
    by = defaultdict(lambda: [0, 0.0])
    for (i, size, words, target, taken) in got:
        assert 0 <= taken <= 2 * size and target <= 2 * words
        by[rows[i][3]][0] += taken
        by[rows[i][3]][1] = target
    total = sum(len(x[1].split()) for x in rows)
    assert abs(sum(t for _, t in by.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken - target) <= 600 for taken, target in by.values())
    assert plain(mixing.plan_mix(spark.createDataFrame(rows[::-1], DOC_SCHEMA)),
                 "doc_id", "size", "source_size", "target", "taken") == got


def test_mix_emits_the_planned_copies(spark):
    df = frame(spark)
    plan = mixing.plan_mix(df)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == plan.groupBy().sum("copies").first()[0]
    want = plan.where("copies > 0").groupBy("doc_id").sum("copies").collect()
    assert {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in want}
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_keeps_columns_named_like_its_own(spark):
    rows = [(k, f"some words {k}", "en", "ab"[k % 2], 12) for k in range(20)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    names = ("_mix_key", "_mix_n", "_mix_own", "_MIX_RN", "_mix_e")
    clashing = df.select("*", *[F.lit(n).alias(n) for n in names])
    got = mixing.mix(clashing)
    assert got.columns == clashing.columns and plain(got, *df.columns) == plain(mixing.mix(df), *df.columns)
    assert all(r[n] == n for r in got.collect() for n in names)
