import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.llm import exact_dedup, language_id, mixing, order_minhash
from riskflow.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import empty, frame
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    df = QUERIES[name](spark, SF)
    res = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(res.fetchall(), res.columns)


def test_pipeline_follows_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, SF), f"test-{name}")
        got = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            model = language_id.fit(before)
            ids = sorted(r.doc_id for r in language_id.predict(before, model).collect()
                         if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE)
        elif name == "exact_dedup":
            ids = sorted({r.keep_id for r in exact_dedup.exact_groups(before).collect()})
        elif name == "minhash_near_dedup":
            ids = sorted(r.doc_id for r in order_minhash.near_duplicate_classes(before).collect() if r.kept)
        elif name == "mix_sources":
            ids = sorted(r.doc_id for r in mixing.plan_mix(before).collect() for _ in range(r.copies))
        assert got == ids
    assert docs.where("not round_trip").count() == 0


@pytest.mark.parametrize("make", [frame, empty])
def test_stages_on_awkward_and_empty_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), f"test-{name}")
    assert docs.columns[0] == "doc_id"
    assert (docs.count() == 0) == (make is empty)
