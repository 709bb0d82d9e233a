import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from riskflow.llm import exact_dedup, order_minhash
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, empty, frame, plain, prose


def test_exact_groups_on_awkward_rows(spark):
    rows = awkward_rows()
    got = plain(exact_dedup.exact_groups(frame(spark)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    want = []
    for r in rows:
        ids = by[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert plain(exact_dedup.exact_groups(frame(spark), keep="smallest").where("group_size = 3"), "keep_id")[0] == (3,)
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(empty(spark), keep="first")


def test_colliding_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = exact_dedup._hashed
    monkeypatch.setattr(exact_dedup, "_hashed", lambda *a: real(*a).withColumn("_h", F.lit(b"same").cast("binary")))
    rows = [(i, t, None, None, None) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    got = plain(exact_dedup.exact_groups(spark.createDataFrame(rows, DOC_SCHEMA)), "doc_id", "keep_id", "group_size")
    assert got == [(0, 5, 3), (1, 4, 2), (2, 5, 3), (3, 3, 1), (4, 4, 2), (5, 5, 3)]


def test_drop_duplicates_keeps_one_row_per_text_and_all_columns(spark):
    df = frame(spark)
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in awkward_rows()})
    assert plain(out.where("text like 'one two%'"), "doc_id") == [(2,)]
    assert exact_dedup.drop_duplicates(empty(spark)).count() == 0


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_plain_table():
    r = random.Random(2)
    for _ in range(400):
        kinds = r.choice([3, 50, 1000])
        a = [r.randint(0, kinds) for _ in range(r.randint(1, 60))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            if r.random() < 0.4 and len(b) > 1:
                b.pop(min(k, len(b) - 1))
            else:
                b.insert(k, r.randint(0, kinds))
        m = _lcs(a, b)
        want, got = m / (len(a) + len(b) - m), order_minhash.alignment_similarity(np.array(a), np.array(b))
        assert (got < 0.8) if want < 0.8 else abs(got - want) < 1e-12


def _edited(text, edits, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randint(0, 10 ** 6)}"
    return " ".join(w)


def _brute_classes(rows, least=0.8):
    maker = order_minhash.Sketcher()
    seqs = [(i, maker.shingles(t)) for i, t in rows]
    up = list(range(len(seqs)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(seqs)):
        for j in range(i):
            if len(seqs[i][1]) and order_minhash.alignment_similarity(seqs[i][1], seqs[j][1], least) >= least:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(seqs):
        groups[find(k)].append(i)
    name = {k: min(v) for k, v in groups.items()}
    return sorted((i, name[find(k)], len(groups[find(k)])) for k, (i, _) in enumerate(seqs))


def test_near_duplicate_classes_match_brute_force(spark):
    rows, n = [], 0
    for base in range(12):
        text = prose(100 + base, 150 + 10 * base)
        for copy in range(base):                     # groups from none to eleven copies
            rows.append((n, _edited(text, copy % 5, base * 31 + copy)))
            n += 1
    shared = prose(7, 40)                            # a passage that many documents share
    for k in range(15):
        rows.append((n, shared + " " + prose(500 + k, 120)))
        n += 1
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    got = plain(order_minhash.near_duplicate_classes(df), "doc_id", "class_id", "class_size")
    assert sorted(got) == _brute_classes(rows)


def test_pairs_of_one_large_group_are_all_aligned(spark):
    # texts of one template with four words changed: those with the same places are
    # at 0.81, all others below 0.8, and no shingle is theirs alone
    r, template = random.Random(4), [f"w{k}" for k in range(200)]
    kinds, rows = set(), []
    while len(kinds) < 700:
        kinds.add(tuple(sorted(r.sample(range(5, 195, 5), 4))))
    for kind in sorted(kinds):
        for copy in range(3):
            words = list(template)
            for k in kind:
                words[k] = f"x{len(rows)}x{k}"
            rows.append((len(rows), " ".join(words), None, None, None))
    r.shuffle(rows)
    got = plain(order_minhash.near_duplicate_classes(spark.createDataFrame(rows, DOC_SCHEMA)), "doc_id", "class_id")
    assert sorted(got) == [(i, i - i % 3) for i in range(2100)]


def test_short_texts_match_brute_force(spark):
    rows = []
    for words in range(1, 21):
        for k in range(4):
            text = prose(1000 * words + k, words).split(" ")
            for copy in (text, ["before", *text], [*text, "behind"], text[1:], text[:-1], ["a", *text, "z"]):
                rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    got = plain(order_minhash.near_duplicate_classes(df), "doc_id", "class_id", "class_size")
    assert sorted(got) == _brute_classes(rows)


def test_a_repeated_shingle_leaves_the_others_labels():
    a = order_minhash.Sketcher().shingles(prose(3, 50))
    b = np.concatenate([a, a[:1]])
    assert (order_minhash.Sketcher.labelled(b)[:-1] == order_minhash.Sketcher.labelled(a)).all()


def test_near_duplicates_on_awkward_rows(spark):
    df = frame(spark)
    got = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in order_minhash.near_duplicate_classes(df).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (9, 9, 2, True), (3, 3, 1, True), (8, 8, 1, True), (6, 6, 1, True)} <= got
    assert order_minhash.near_duplicate_classes(df).count() == len(awkward_rows())
    kept = order_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert kept.count() == len(awkward_rows()) - 1
    assert order_minhash.near_duplicate_classes(empty(spark)).count() == 0


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    t = prose(21, 150)
    rows = [(3, t), (5, t + " extra"), (5, prose(22, 150)), (None, t + " more"), (None, prose(23, 150)), (7, prose(24, 150)),
            (8, prose(25, 150)), (8, prose(25, 150) + " more")]
    df = spark.createDataFrame([(i, x, None, None, None, "a", "b", "c") for i, x in rows],
                               DOC_SCHEMA + ", _lost string, _lost_id string, _text_hash string")
    kept = order_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = plain(kept, "doc_id", "text")
    assert len(got) == 5 and set(got) >= {(3, t), rows[2], rows[4], rows[5]}
    assert sum(i == 8 for i, _ in got) == 1


def test_sketch_keeps_text_order():
    maker = order_minhash.Sketcher()
    a = maker.shingles(prose(1, 300))
    assert (maker.sketch(a) == maker.sketch(a)).all()
    swapped = np.concatenate([a[150:], a[:150]])
    assert (maker.sketch(a) == maker.sketch(swapped)).mean() < 0.4
    assert len(set(maker.labelled(np.repeat(a[:1], 5)).tolist())) == 5
