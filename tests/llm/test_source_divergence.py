import random
import re
from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from riskflow.llm import source_divergence as sd
from riskflow.llm.queries import ORACLE
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, empty, frame, plain

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _plain_version(rows, least):
    docs = [((lang or ""), (source or ""), TERM.findall(_lower(text or ""))) for _, text, lang, source, *_ in rows]
    seen, groups = defaultdict(Counter), {}
    for lang, source, words in docs:
        seen[lang].update(set(words))
        groups.setdefault((lang, source), Counter()).update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=lambda t: t.encode())
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * v
            return {t: 1 + (10 ** 9 * (counts[t] + 2)) // total for t in kept}
        own = {s: c for (x, s), c in groups.items() if x == lang}
        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))

        def far(a, b):
            return (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            used = [(far(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", used, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


def _rows(n=600):
    r = random.Random(6)
    words = [w for k in range(120) for w in (f"w{chr(97 + k % 26)}{chr(97 + k // 26)}", f"É{chr(97 + k % 26)}漢")]
    rows = []
    for k in range(n):
        lang = r.choice(["en", "en", "en", "de", None])
        source = "hot" if k % 3 == 0 else r.choice(["a", "b", "é", None])
        text = " ".join(r.choice(words[:r.choice([5, 40, 240])]).title() + str(r.randint(0, 9)) for _ in range(r.randint(0, 30)))
        rows.append((k, text, lang, source, None))
    return rows + [(9001, "solo", "xx", "a", None), (9002, None, "xx", "b", None), (9003, "solo", "yy", "only", None)]


def test_audit_matches_the_plain_version(spark):
    rows = _rows()
    got = plain(sd.audit(spark.createDataFrame(rows, DOC_SCHEMA)), *COLUMNS)
    assert got == _plain_version(rows, 10)
    assert {g[2] for g in got} == {"pair", "term"} and any(g[0] == "xx" and g[4] == 0 for g in got)


def test_audit_matches_sql(spark):
    df = spark.createDataFrame(_rows(300), DOC_SCHEMA)
    documents = df.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841  duckdb reads it by name
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_source_divergence']})").fetchall()
    assert plain(sd.audit(df), *COLUMNS) == sorted(map(tuple, want), key=repr)


def test_audit_on_awkward_rows(spark):
    got = plain(sd.audit(frame(spark), least=1), *COLUMNS)
    assert got == _plain_version(awkward_rows(), 1)
    assert sd.audit(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, "12 34", None, "b", None)], DOC_SCHEMA)
    assert plain(sd.audit(nothing), *COLUMNS) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_rounds_and_flushes_change_nothing(spark, monkeypatch):
    texts = sd._texts(spark.createDataFrame(_rows(), DOC_SCHEMA), "text", "lang", "source")
    monkeypatch.setattr(sd, "SHARD_TERMS", 32)
    hashes = sd.build_hashes(sd.kept_terms(texts))
    assert hashes.count() > 6
    cols = ("lang", "source", "shard", "slot", "n")
    whole = plain(sd.recount(texts, hashes), *cols)
    monkeypatch.setattr(sd, "HELD_TERMS", 50)
    monkeypatch.setattr(sd, "HELD_WORDS", 30)
    monkeypatch.setattr(sd, "TASK_SLOTS", 40)
    assert plain(sd.recount(texts, hashes, round_bytes=4000), *cols) == whole


def test_hash_is_minimal_perfect_and_tells_other_terms():
    keys = [f"term{i}".encode() for i in range(5000)] + ["é漢".encode()]
    parts = defaultdict(list)
    for k in keys:
        h = xxhash.xxh64_intdigest(k, 42)
        parts[(h - (1 << 64) if h >> 63 else h) % 3].append(k)
    found = sd.ShardedHash(3, [(s, *sd.build_shard(part)) for s, part in parts.items()])
    at, slot = found.find([*keys, b"unknown", b"term5001"])
    assert at.tolist() == list(range(len(keys))) and sorted(slot.tolist()) == list(range(len(keys)))
    for size in (1, 2, 3, 17):
        _, shift, stored = sd.build_shard(keys[:size])
        assert sorted(stored) == sorted(keys[:size])


def test_spark_and_worker_hash_alike(spark):
    words = ["a", "straße", "漢字", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
