import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from riskflow.llm import fill_middle
from riskflow.llm.queries import ORACLE
from tests.llm.helpers import DOC_SCHEMA, empty, frame, plain, prose

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 50:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def _rows():
    r = random.Random(11)
    rows = [(i, None if i % 17 == 0 else "".join(r.choice(["é", "漢", "😀", "a", "b ", "\n", "\n\n", "\r\n", "<", ">", "P"])
                                               for _ in range(r.choice([0, 1, 2, 30, 400])))) for i in range(200)]
    rows += [(900, "a <P> marker"), (901, "<S>\n<M>\n"), (902, "<P\n>S>"), (903, "no line feed"), (904, "\n"),
             (905, ("漢字 line\n" * 3000) + "tail"), (906, prose(3, 30_000).replace(" ", "\n", 9000)), (-5, "x\ny\nz"),
             (None, "l1\nl2\nl3"), (7, "same\nid\n"), (7, "same\nid\n"), (7, "other\ntext\n\n")]
    return [(i, t, None, None, None) for i, t in rows]


def test_matches_the_plain_version(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = plain(fill_middle.fill_in_middle(df), "doc_id", "n", "form", "output", "prefix_chars", "middle_chars")
    assert got == sorted(((i, *_plain_version(i, t)) for i, t, *_ in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_output_and_form_give_the_text_back(spark):
    df = spark.createDataFrame(_rows(), DOC_SCHEMA)
    done = fill_middle.fill_in_middle(df).select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("text"))
    assert plain(done, "doc_id", "text") == plain(df.fillna("", ["text"]), "doc_id", "text")


def test_matches_sql_on_awkward_rows(spark):
    df = frame(spark)
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  duckdb reads it by name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op13_fill_middle']})").fetchall()
    got = fill_middle.digests(fill_middle.fill_in_middle(df))
    assert plain(got, *COLUMNS) == sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in want), key=repr)
    assert fill_middle.digests(fill_middle.fill_in_middle(empty(spark))).count() == 0


def test_tree_cuts_at_every_unit_and_block_size():
    r = random.Random(2)
    for block in (1, 2, 3, 7, 64):
        text = "".join(r.choice(["é", "x", "\n", "漢", "\n\n", "😀"]) for _ in range(150))
        tree = fill_middle.BlockTree(text.encode(), block)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert tree.n == len(units) and tree.code_points == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_rates(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n", None, None, None) for i in range(300)], DOC_SCHEMA)
    forms = {f: n for f, n in fill_middle.fill_in_middle(df, rate=50, spm_rate=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 100 < forms["plain"] < 200
