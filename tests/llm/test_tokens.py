import random

import pytest
import sentencepiece

from riskflow.llm import sentencepiece_codec as codec
from tests.llm.helpers import awkward_rows, empty, frame, prose


@pytest.fixture(scope="module")
def model():
    return codec.read_model()


def test_equals_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    r = random.Random(1)
    letters = "abcethnis  \n\t▁éñ漢字😀ABC<>x0A.,'\"0123"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["", " ", "   ", "a" * 3000, " " * 50 + "x", "<s>", "<0x0A>", "the   end  ", "\x00a", prose(4, 2000)]
    seg = codec.Segmenter(model)
    got = seg.encode(texts)
    assert got == lib.encode(texts)
    assert [seg.decode(x) for x in got] == lib.decode(got)
    assert all(seg.decode(x) == t for x, t in zip(got, texts, strict=True) if "▁" not in t)


def test_common_prefixes_are_computed_once(model):
    seg = codec.Segmenter(model)
    words = ["▁" + "harbour" + x for x in ("", "s", "ing", "master", "masters")]
    seg.learn(words)
    assert seg.steps == len("▁harbour") + len("s") + len("ing") + len("master") + len("s")


def test_unigram_models_take_the_best_path():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.2, "bb": -5.0}
    model = codec.Model(codec.UNIGRAM, scores, {p: k for k, p in enumerate(scores)}, [-1] * 256, 99,
                        [p.encode() for p in scores], True, b"toy")
    seg = codec.Segmenter(model)

    def best(word):
        if not word:
            return 0.0, []
        return max((best(word[:-n])[0] + scores[word[-n:]], best(word[:-n])[1] + [word[-n:]])
                   for n in (1, 2) if len(word) >= n and word[-n:] in scores)

    for word in ("▁ab", "▁abb", "▁aab", "▁bbab"):
        seg.learn([word])
        assert seg.words[word].tolist() == [model.ids[p] for p in best(word)[1]]


def test_round_trip_on_awkward_rows(spark):
    got = codec.round_trip(frame(spark)).collect()
    assert len(got) == len(awkward_rows()) and all(r.round_trip for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    tokens = codec.encode(frame(spark))
    back = {r.doc_id: r.text for r in codec.decode(tokens).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in awkward_rows() if r[0] is not None)
    assert codec.round_trip(empty(spark)).count() == 0
