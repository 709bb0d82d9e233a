import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from riskflow.llm import fingerprint, language_id, lm_scoring
from tests.llm.helpers import DOC_SCHEMA, awkward_rows, empty, frame, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_on_held_out_documents(spark, documents):
    model = language_id.fit(documents)
    got = language_id.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_backoff_uses_shorter_ngrams():
    entries = [(True, "hello", [{"lang": "a", "n": 9}]), (True, "salut", [{"lang": "b", "n": 9}]),
               (False, "^hel", [{"lang": "a", "n": 9}]), (False, "z", [{"lang": "b", "n": 9}])]
    scorer = language_id.Scorer(language_id._model(entries))
    assert scorer.word("hello") == scorer.model.words["hello"]
    assert scorer.word("helm") == scorer.model.grams["^hel"]       # no known 5-gram, a known 4-gram
    assert scorer.word("zq") == scorer.model.grams["z"]
    assert scorer.word("q") == [0.0, 0.0]
    assert scorer.text("hello helm")[0] == "a" and scorer.text("zz salut")[0] == "b"
    assert scorer.text("12 !?") == scorer.text(None) == ("und", 0.0)


def test_language_on_awkward_rows(spark):
    df = frame(spark)
    model = language_id.fit(df, min_count=1)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(awkward_rows())
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 8)} == {"und"}
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (3, 4, 5, 8)").count() == 0
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def test_language_sample_and_model_stay_bounded(spark, monkeypatch):
    rows = [(None, f"word{str(k).translate(str.maketrans('0123456789', 'abcdefghij'))} common", "en", None, None)
            for k in range(3000)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    seen = language_id.fit(df, sample_docs=300, min_count=1).words
    assert 150 < len(seen) < 600                       # rows without an id are sampled like others
    monkeypatch.setattr(language_id, "MODEL_ENTRIES", 40)
    small = language_id.fit(df, sample_docs=300, min_count=1)
    assert 0 < len(small.words) + len(small.grams) <= 40


def _plain_scores(rows, targets):
    seq = [(i, ["<s>", *lm_scoring._WORDS.findall((t or "").lower()), "</s>"]) for i, t in rows]
    pn, pt, cn, ct, w = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, s in seq:
        w.update(s[1:])
        pn.update(zip(s, s[1:]))
        cn.update(s[:-1])
        if i in targets:
            pt.update(zip(s, s[1:]))
            ct.update(s[:-1])
    n = sum(w.values())

    def loss(p, pairs, contexts):
        return -math.log((pairs[p] + 50 * w[p[1]] / n) / (contexts[p[0]] + 50))

    out = []
    for i, s in seq:
        t, b = (sum(loss(p, *c) for p in zip(s, s[1:])) / (len(s) - 1) for c in ((pt, ct), (pn, cn)))
        out.append((i, len(s) - 1, round(t, 9), round(b, 9), round(t - b, 8)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,shard", [(6_000_000, 12_000_000), (3000, 20_000), (40_000, 2000)])
def test_scores_match_plain_counts(spark, block, shard):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    rows += [(100 + k, "the of " * 20 + prose(k, 80)) for k in range(40)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOC_SCHEMA)
    targets = [1, 9, *range(100, 120)]
    got = lm_scoring.score_documents(df, targets, block_chars=block, shard_chars=shard).collect()
    assert sorted(((r.doc_id, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9), round(r.score, 8))
                   for r in got), key=repr) == _plain_scores(rows, set(targets))


def test_scores_keep_text_ids(spark):
    rows = [("a\nb", "one two"), ("", "three"), (None, "four"), ("null", None), ("a\nb", "one two")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for targets in (["a\nb", ""], []):
        got = lm_scoring.score_documents(df, targets).collect()
        assert sorted(((r.doc_id, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9), round(r.score, 8))
                       for r in got), key=repr) == _plain_scores(rows, set(targets))


def test_every_labelled_document_is_a_target(spark):
    # far more labels than any cap: half of the documents are good and share a word
    n = 50_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'good words', 'other words') as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as quality")
    labels = labels.unionByName(labels.where("doc_id < 10"))          # repeated labels count once
    got = lm_scoring.score_documents(docs, lm_scoring.target_ids(labels)).where("doc_id < 2").collect()
    (good,) = (r.target_loss for r in got if r.doc_id == 0)
    t = n // 2
    share = {"good": 0.5 / 3, "words": 1 / 3, "end": 1 / 3}
    want = -sum(math.log((t + 50 * b) / (t + 50)) for b in share.values()) / 3
    assert good == pytest.approx(want, abs=1e-12)


def test_scores_rank_good_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert lm_scoring.score_documents(empty(spark), []).count() == 0
    targets = lm_scoring.target_ids(labels.where("doc_id % 2 = 0"))
    score = {r.doc_id: r.score for r in lm_scoring.score_documents(documents, targets).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good, bad = ([score[r.doc_id] for r in held if r.quality == q] for q in (1, 0))
    assert sum(a < b for a in good for b in bad) / len(good) / len(bad) > 0.65


def test_fingerprints_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] not in (None, 9)]
    rows += [(1000 + k, prose(k, 30 + 40 * (k % 9))) for k in range(60)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], DOC_SCHEMA)
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df, range_rows=7).collect()}
    maker = fingerprint.Fingerprinter(fingerprint.fit_rarity(df))
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        own, new, other = (maker.filters(t) for t in (text, edited, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.as_text(own), fingerprint.as_text(new))
        assert abs(r.near_edited - fingerprint.likeness(own, new)) < 1e-9
        assert abs(r.near_next - fingerprint.likeness(own, other)) < 1e-9


def test_fingerprint_likeness():
    maker = fingerprint.Fingerprinter(list(range(fingerprint.BINS)))
    text = prose(1, 3000)
    own = maker.filters(text)
    again = fingerprint.from_text(fingerprint.as_text(own))
    assert len(own[0]) > 1 and fingerprint.likeness(own, again) == pytest.approx(1.0)
    assert fingerprint.likeness(own, maker.filters("a new start " + text)) > 0.8
    assert fingerprint.likeness(own, maker.filters(text[:len(text) // 2] + prose(2, 1500))) > 0.3
    assert fingerprint.likeness(own, maker.filters(prose(3, 3000))) < 0.1
    nothing = maker.filters("")
    assert fingerprint.likeness(nothing, nothing) == 1.0 and fingerprint.likeness(nothing, own) == 0.0


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4E00 + 2000))), "กขคงจฉชซ",
                                     "ABCDEFabcdef0123456789+/"])
def test_fingerprints_of_unspaced_texts_cover_all_of_it(letters):
    maker = fingerprint.Fingerprinter(list(range(fingerprint.BINS)))
    r = random.Random(1)
    text, other = ("".join(r.choice(letters) for _ in range(1500)) for _ in range(2))
    half = text[:750] + other[:750]
    for around in ("%s", "some words before %s and after"):
        own = maker.filters(around % text)
        assert 0.2 < fingerprint.likeness(own, maker.filters(around % half)) < 0.8
        assert fingerprint.likeness(own, maker.filters(around % (text[:20] + other))) < 0.2
        assert fingerprint.likeness(own, maker.filters(around % ("x" + text))) > 0.9
    data = fingerprint._as_array(text)
    starts = fingerprint._starts(data)
    assert np.diff(starts).max() <= 4 and starts[0] == 0 and starts[-1] == len(data) - fingerprint.WINDOW


def test_entropy_bins_match_a_direct_count():
    data = fingerprint._as_array(prose(1, 200) + " " + "a" * 100 + " " + prose(2, 50))
    starts = fingerprint._starts(data)
    got = fingerprint._entropies(data, starts)
    for s, g in zip(starts, got, strict=True):
        c = Counter(data[s:s + fingerprint.WINDOW].tolist()).values()
        h = -sum(n / fingerprint.WINDOW * math.log2(n / fingerprint.WINDOW) for n in c)
        assert abs(g - h / math.log2(fingerprint.WINDOW) * fingerprint.BINS) <= 1.01


def test_fingerprints_on_awkward_rows(spark):
    got = fingerprint.fingerprint_documents(frame(spark)).collect()
    assert len(got) == len(awkward_rows())
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and all(0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "alone in the table", None, None, None)], DOC_SCHEMA)
    assert fingerprint.fingerprint_documents(one).first().near_next == pytest.approx(1.0)


def test_windows_of_the_edited_text_are_taken_over():
    r = random.Random(12)
    maker = fingerprint.Fingerprinter(list(range(fingerprint.BINS)))
    texts = [prose(k, n) for k, n in enumerate((0, 1, 3, 9, 40, 300))]
    texts += ["漢字" * n for n in (1, 5, 40, 200)] + ["x" * 500, "a b " * 50, "é" * 33 + " " + "ü" * 90, "tail" + "漢" * 60]
    for _ in range(300):
        a, b = r.choice(texts), r.choice(texts)
        kept, put = a[:r.randint(0, len(a))], b[:r.randint(0, len(b))]
        got = maker.joined(maker.measured(a), maker.measured(b), len(kept.encode()), len(put.encode()))
        want = maker.measured(kept + put)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_packed_language_model(documents, monkeypatch):
    """What the workers hold is a fraction of the dictionaries, and scores are those of a plain sum."""
    import sys

    import pyarrow as pa
    texts = [r.text for r in documents.select("text").limit(300).collect()] + [None, "", "12 3", "zqx qqqzz"]
    entries = Counter((w, ("en", "fr")[k % 2]) for k, t in enumerate(texts) for w in language_id.re.findall(language_id.WORD, (t or "").lower()))
    items: dict = {}
    for (w, lang), n in entries.items():
        for kind, item in [(True, w)] + [(False, g) for m in range(1, 6) for g in language_id.grams_of(w, m)]:
            items.setdefault((kind, item), Counter())[lang] += n
    model = language_id._model([(*k, [{"lang": x, "n": n} for x, n in c.items()]) for k, c in items.items() if c.total() > 1])
    packed = language_id.pack(model)
    tables = [packed.words, *packed.grams.values()]
    plain = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) + 24 * len(v) for k, v in d.items())
                for d in (model.words, model.grams))
    assert sum(keys.nbytes + logs.nbytes for keys, logs in tables) < plain / 4

    def vector(w):
        if w in model.words:
            return model.words[w]
        for n in range(min(5, len(w) + 2), 0, -1):
            hits = [model.grams[g] for g in language_id.grams_of(w, n) if g in model.grams]
            if hits:
                return [sum(h[k] for h in hits) / len(hits) for k in range(2)]
        return model.unseen

    want = []
    for t in texts:
        words = Counter(language_id.re.findall(language_id.WORD, (t or "").lower()))
        sums = [0.0, 0.0]
        for w in sorted(words):
            for k, v in enumerate(vector(w)):
                sums[k] += words[w] * v
        scale = math.sqrt(words.total()) / max(words.total(), 1)
        best = max((0, 1), key=lambda k: (sums[k], -k))
        want.append((model.languages[best], 1.0 / sum(math.exp((s - sums[best]) * scale) for s in sums)) if words else ("und", 0.0))
    for held in (50_000, 3):
        monkeypatch.setattr(language_id, "CACHE_WORDS", held)
        assert list(language_id.Scorer(packed).texts(texts)) == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["x"])
    from riskflow.llm import common
    assert [b.num_rows for b in common.slices([batch, batch.slice(0, 0)])] == [1000, 1000, 500]
