"""Language identification by known words first, then shorter n-grams.

A model holds, per language, log frequencies of words and of character n-grams
(with word borders) of 1 to ``MAX_N`` characters. A word the model knows is
scored by its log frequency in each language; an unseen word backs off to its
n-grams of ``MAX_N`` characters that the model knows, else to the next shorter
ones. A text's score per language is the sum over its words; the largest wins
(ties: the first language in order). ``score`` is the winner's share of the
softmax over the mean per word, scaled by the square root of the word count.

Fitting reads a bounded sample: per language about ``SAMPLE_DOCS`` labelled
rows, chosen by a hash of the id (all of them where a language has fewer). The
whole text of each sampled row counts. Words and n-grams are counted with
map-side combination; those seen at least ``MIN_COUNT`` times make the model,
so its size is bounded by the sample, not by the corpus, and it may be sent to
all workers. ``MODEL_ENTRIES`` guards that bound: a larger model is an error.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Only the text is an input of a prediction. Rows with a null language are not
learned from; with nothing to learn from every text is ``und``. Repeated rows
get equal results; only id, text and language are read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import held_out, ship, unit_hash

__all__ = ["UNDETERMINED", "Model", "fit", "predict", "keep_identified"]

UNDETERMINED = "und"
WORD = r"[^\W\d_]+"
MAX_N = 5
SAMPLE_DOCS = 4000
MIN_COUNT = 3
MODEL_ENTRIES = 4_000_000
MAX_LANGUAGES = 1000
# Words and n-grams that a task counts, and words that it looks up, at a time.
COUNT_WORDS = 100_000
CACHE_WORDS = 50_000
CACHE_ENTRIES = 1_000_000
# Scores below this are rejected by the filtering stage.
LEAST_SCORE = 0.5


class Model(NamedTuple):
    languages: list[str]
    words: dict[str, list[float]]
    grams: dict[str, list[float]]
    unseen: list[float]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa
    words: Counter = Counter()
    find = re.compile(WORD).findall

    def flush():
        grams: Counter = Counter()
        for (lang, w), k in words.items():
            for n in range(1, MAX_N + 1):
                for g in grams_of(w, n):
                    grams[lang, g] += k
        for kind, c in ((True, words), (False, grams)):
            keys = list(c)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part]), pa.array([kind] * len(part)),
                     pa.array([x[1] for x in part]), pa.array([c[x] for x in part], pa.int64())],
                    names=["lang", "is_word", "item", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in find(text.lower()):
                words[lang, w] += 1
        if len(words) > COUNT_WORDS:
            yield from flush()
            words.clear()
    yield from flush()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, min_count: int = MIN_COUNT) -> Model:
    """Learn from labelled rows outside the held-out third. Where the model exceeds
    its bound, ``min_count`` doubles until it does not."""
    ship(df)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    # one row per language label; texts are filtered where they are read
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows")).limit(MAX_LANGUAGES + 1).collect()
    if not sizes:
        return Model([], {}, {}, [])
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_lang"], min(1.0, sample_docs / r["_rows"]))])
    # rows without an id are drawn by their text
    drawn = unit_hash(F.coalesce(F.col("_id").cast("string"), F.col("_text")), "langid")
    sample = rows.where(drawn < share[F.col("_lang")]).select("_text", "_lang")
    counted = (sample.mapInArrow(_count, "lang string, is_word boolean, item string, n bigint")
                     .groupBy("is_word", "item", "lang").agg(F.sum("n").alias("n"))
                     .groupBy("is_word", "item")
                     .agg(F.collect_list(F.struct("lang", "n")).alias("per"), F.sum("n").alias("all"))
                     .where(F.col("all") >= min_count).select("is_word", "item", "per"))
    entries = counted.toArrow()
    if entries.num_rows > MODEL_ENTRIES:
        return fit(df, id_col, text_col, lang_col, sample_docs, 2 * min_count)
    return _model(zip(*(entries.column(c).to_pylist() for c in ("is_word", "item", "per")), strict=True))


def _model(entries) -> Model:
    """Smoothed log frequencies from (is_word, item, [{lang, n}, ...])."""
    entries = sorted(entries, key=lambda e: (e[0], e[1]))
    langs = sorted({p["lang"] for e in entries for p in e[2]})
    at = {lang: k for k, lang in enumerate(langs)}
    totals: dict = {}
    for is_word, item, per in entries:
        t = totals.setdefault(0 if is_word else len(item), [0, [0] * len(langs)])
        t[0] += 1
        for p in per:
            t[1][at[p["lang"]]] += p["n"]
    out: tuple[dict, dict] = ({}, {})
    for is_word, item, per in entries:
        kinds, sums = totals[0 if is_word else len(item)]
        n = [0] * len(langs)
        for p in per:
            n[at[p["lang"]]] = p["n"]
        out[0 if is_word else 1][item] = [math.log((n[k] + 0.5) / (sums[k] + 0.5 * kinds)) for k in range(len(langs))]
    return Model(langs, out[0], out[1], [0.0] * len(langs))


class Packed(NamedTuple):
    """A model as the workers hold it: items as one Arrow array and their log
    frequencies as one matrix per kind, a tenth of the dictionaries' memory.
    ``grams`` has one pair per length."""
    languages: list[str]
    words: tuple
    grams: dict[int, tuple]
    unseen: list[float]


def pack(model: Model) -> Packed:
    import numpy as np
    import pyarrow as pa

    def table(items: list[str], logs: dict) -> tuple:
        return (pa.array(items, pa.large_string()),
                np.array([logs[i] for i in items], dtype=float).reshape(len(items), len(model.languages)))
    by_length: dict[int, list[str]] = {}
    for g in model.grams:
        by_length.setdefault(len(g), []).append(g)
    return Packed(model.languages, table(list(model.words), model.words),
                  {n: table(items, model.grams) for n, items in by_length.items()}, model.unseen)


class Scorer:
    def __init__(self, model: Model | Packed):
        self.model = model
        self.packed = model if isinstance(model, Packed) else pack(model)
        self.find = re.compile(WORD).findall

    def vectors(self, words: list[str]):
        """A row of log frequencies per word."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        m = self.packed
        out = np.empty((len(words), len(m.languages)))

        def places(items: list[str], known) -> np.ndarray:
            found = pc.index_in(pa.array(items, pa.large_string()), value_set=known)
            return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        at = places(words, m.words[0])
        out[at >= 0] = m.words[1][at[at >= 0]]
        left = np.flatnonzero(at < 0).tolist()
        for n in range(MAX_N, 0, -1):
            # a word has no grams longer than itself with its borders
            tried = [i for i in left if len(words[i]) + 2 >= n]
            if n not in m.grams or not tried:
                continue
            grams = [grams_of(words[i], n) for i in tried]
            known, logs = m.grams[n]
            at, begin, done = places([g for gs in grams for g in gs], known), 0, set()
            for i, gs in zip(tried, grams, strict=True):
                own = at[begin:begin + len(gs)]
                begin += len(gs)
                hits = logs[own[own >= 0]].tolist()
                if hits:
                    # the mean, so a word weighs the same however many n-grams are known
                    out[i] = [sum(column) / len(hits) for column in zip(*hits, strict=True)]
                    done.add(i)
            left = [i for i in left if i not in done]
        out[left] = m.unseen
        return out

    def word(self, w: str) -> list[float]:
        return self.vectors([w])[0].tolist()

    def text(self, text: str | None) -> tuple[str, float]:
        return next(self.texts([text]))

    def texts(self, texts) -> Iterator[tuple[str, float]]:
        """Language and score of each text. Words are looked up for many texts at
        once; what waits for them is bounded by ``CACHE_WORDS`` and ``CACHE_ENTRIES``."""
        import numpy as np
        seen: dict[str, int] = {}
        waiting, entries = [], 0
        for text in texts:
            words = Counter(self.find(text.lower())) if text and self.packed.languages else None
            if not words:
                waiting.append(None)
                continue
            order = sorted(words)
            waiting.append((np.array([seen.setdefault(w, len(seen)) for w in order], np.int32),
                            np.array([words[w] for w in order], float)))
            entries += len(order)
            if len(seen) > CACHE_WORDS or entries > CACHE_ENTRIES:
                yield from self._results(seen, waiting)
                seen, waiting, entries = {}, [], 0
        yield from self._results(seen, waiting)

    def _results(self, seen: dict[str, int], waiting: list) -> Iterator[tuple[str, float]]:
        langs = self.packed.languages
        logs = self.vectors(list(seen)) if seen else None
        for found in waiting:
            if found is None:
                yield UNDETERMINED, 0.0
                continue
            at, n = found
            # a running sum adds the words one after the other, in their order
            sums = (logs[at] * n[:, None]).cumsum(axis=0)[-1].tolist()
            total = int(n.sum())
            best = max(range(len(langs)), key=lambda k: (sums[k], -k))
            scale = math.sqrt(total) / total
            yield langs[best], 1.0 / sum(math.exp((s - sums[best]) * scale) for s in sums)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred``, ``score``."""
    spark = ship(df)
    sent = spark.sparkContext.broadcast(pack(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        scorer = Scorer(sent.value)
        for batch in batches:
            found = list(scorer.texts(t.as_py() for t in batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["_id", "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return (rows.mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double")
                .withColumnRenamed("_id", id_col))


def keep_identified(df: DataFrame, model: Model, text_col: str = "text",
                    least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df`` whose language is identified with at least
    ``least_score``, with all their columns. No shuffle."""
    spark = ship(df)
    sent = spark.sparkContext.broadcast(pack(model))

    @F.arrow_udf("boolean")
    def identified(texts):
        import pyarrow as pa
        scorer = Scorer(sent.value)
        found = scorer.texts(t.as_py() for t in texts)
        return pa.array([lang != UNDETERMINED and score >= least_score for lang, score in found], pa.bool_())

    return df.where(identified(F.col(text_col)))
