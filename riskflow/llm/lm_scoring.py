"""Cross-entropy difference of two matched n-gram language models.

A target model (documents labelled good) and a background model (all documents)
are bigram models over one vocabulary - every word of the corpus, a start and
an end mark - with the same smoothing:

    P(w | c) = (n(c, w) + MASS * B(w)) / (n(c) + MASS)

``B`` is shared: the frequency of each word among all tokens (words and end
marks) of the corpus. A document's score is the mean over its tokens of the
target's loss minus the background's loss: the lower, the more the document is
like the target.

How it runs
  1. Documents are dealt by a hash of their id to blocks of about ``BLOCK_CHARS``
     characters, and the labelled ids with them, so a block knows which of its
     documents are targets. What a block holds depends on the rows alone, not on
     their order, so a task that is run again gives the same rows.
  2. A block counts its distinct words and pairs of neighbours, for all and for
     the target's documents, and deals these keys to shards by hash. A word or
     pair is in a block once, however often it occurs, so neither gathers in a
     shard. The number of tokens is counted the same way, as one more key.
  3. A shard adds the counts of each key and returns them to every block that
     has the key, in the order in which they came.
  4. The counts meet the block's texts again (the same exchange of them); the
     block works out the loss of each of its pairs and adds them by document.
A block sends and gets a few bytes per distinct key, so the exchanged volume
grows with the corpus whatever the number of shards, a shard's size does not
grow, and nothing is broadcast or collected. A key travels as 48 bits of its hash
besides those that choose the shard: with 2 million keys a shard, one shard in
some hundred has two keys counted as one.

Every word but the end mark is a context as often as it is predicted, so the
counts of words serve ``B(w)`` and ``n(c)``. A loss is the sum of
``-log(n(c, w) + MASS * B(w))`` and ``log(n(c) + MASS)``; the latter is added
where the context itself was predicted, the start mark's once a document.

Defined cases: a null or empty text is the end mark alone (``n_tokens`` 1). Rows
repeated with one id and text give equal rows. Documents with a null id are
scored and never targets; they are dealt by their text. Rows that share an id
are in one block, so their texts must fit a task. Without a target document the target model is ``B``.
Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship

__all__ = ["target_ids", "score_documents"]

MASS = 50.0
BLOCK_CHARS = 6_000_000
SHARD_CHARS = 12_000_000
_CACHE = 500_000
_WORDS = re.compile(r"\w+")
# Keys of the marks and of the number of tokens.
START, END, TOTAL = np.uint64(1), np.uint64(2), np.uint64(3)


class _WordHash(dict):
    """64-bit hashes of words, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) | 4
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(context) + word * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(4)


class _Reader:
    def __init__(self):
        self.table = _WordHash()

    def tokens(self, text: str | None) -> np.ndarray:
        """Start mark, words, end mark."""
        found = _WORDS.findall(text.lower()) if text else []
        out = np.empty(len(found) + 2, np.uint64)
        out[0], out[-1] = START, END
        table = self.table
        out[1:-1] = np.fromiter((table[w] for w in found), np.uint64, len(found))
        return out


def target_ids(labels: DataFrame, id_col: str = "doc_id", flag_col: str = "quality") -> DataFrame:
    """One column, the ids of all rows with flag 1."""
    return labels.where(F.col(flag_col) == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()


SENT = "block long, shard int, keys binary, n binary, t binary"
COUNTED = "block long, shard int, n binary, t binary"
SCORES = "_id string, n_tokens bigint, target_loss double, background_loss double"


def _fields(*binaries: str):
    import pyarrow as pa
    return pa.schema([("block", pa.int64()), ("shard", pa.int32()), *[(b, pa.binary()) for b in binaries]])


def _pack(x: np.ndarray) -> bytes:
    """Counts byte by byte: the mostly empty high bytes lie together and compress away."""
    return x.astype("<i8").view(np.uint8).reshape(len(x), 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class _Block:
    """The documents of a block, ordered by id and text, with its distinct keys in
    the order of the shards."""

    def __init__(self, rows, shards: int):
        texts = zip(rows["_id"].to_pylist(), rows["_text"].to_pylist(), strict=True)
        texts = sorted(texts, key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        self.ids = [i for i, _ in texts]
        reader = _Reader()
        tokens = [reader.tokens(x) for _, x in texts]
        self.lengths = np.array([len(x) - 1 for x in tokens], np.int64)
        tokens = np.concatenate(tokens)
        self.words, self.word = np.unique(tokens, return_inverse=True)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(self.lengths + 1) - 1] = False               # an end mark is no context
        self.at = np.flatnonzero(inner)
        pairs, self.first, self.pair = np.unique(pair_key(tokens[self.at], tokens[self.at + 1]),
                                                 return_index=True, return_inverse=True)
        keys = np.concatenate([[TOTAL], self.words, pairs])
        shard = (_mix(keys) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.keys, self.borders = keys[self.order], np.searchsorted(shard[self.order], np.arange(shards + 1))

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Occurrences of each key, the documents weighted."""
        by_token = np.repeat(weights, self.lengths + 1)
        found = np.concatenate([[self.lengths @ weights], np.bincount(self.word, by_token, len(self.words)),
                                np.bincount(self.pair, by_token[self.at], len(self.first))])
        return found.astype(np.int64)[self.order]

    def losses(self, n: np.ndarray, t: np.ndarray) -> list:
        """(target, background) loss per token of each document, from the counts of the keys."""
        back = np.argsort(self.order)
        n, t = n[back], t[back]
        k = 1 + len(self.words)
        predicted = self.word[self.at[self.first] + 1]
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        base = MASS * n[1:k][predicted] / n[0]
        out = []
        for count in (t, n):
            context = np.where(self.words == END, 0.0, np.log(count[1:k] + MASS))
            value = context[predicted] - np.log(count[k:] + base)
            added = np.bincount(doc, value[self.pair], len(self.lengths))
            out.append((added + context[np.searchsorted(self.words, START)]) / self.lengths)
        return out


def _cut(shards: int):
    """A block's counts: a row for each shard that has keys of it."""
    def run(rows, targets):
        import pyarrow as pa
        fields = _fields("keys", "n", "t")
        if not len(rows):
            return fields.empty_table()
        block = _Block(rows, shards)
        known = set(targets["_target"].to_pylist())
        n = block.counts(np.ones(len(block.ids)))
        t = block.counts(np.array([i in known for i in block.ids], np.float64))
        low = block.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        used = np.flatnonzero(np.diff(block.borders))
        parts = [slice(block.borders[s], block.borders[s + 1]) for s in used]
        return pa.table([pa.array([rows["block"][0].as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()),
                         pa.array([low[p].tobytes() for p in parts], pa.binary()),
                         *[pa.array([_pack(c[p]) for p in parts], pa.binary()) for c in (n, t)]], schema=fields)
    return run


def _count(table):
    """The counts of a shard's keys over all blocks, for each block that has them."""
    import pyarrow as pa
    data = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table["keys"].to_pylist()]
    borders = np.cumsum([0] + [len(x) for x in data])
    wide = np.zeros((borders[-1], 8), np.uint8)
    wide[:, :6] = np.concatenate(data)
    del data
    kinds, at = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    del wide
    out = [table["block"], table["shard"]]
    for c in ("n", "t"):
        sums = np.bincount(at, np.concatenate([_unpack(x) for x in table[c].to_pylist()]), len(kinds)).astype(np.int64)
        out.append(pa.array([_pack(sums[at[a:b]]) for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary()))
    return pa.table(out, schema=_fields("n", "t"))


def _score(shards: int):
    """The documents of one block with their losses per token."""
    def run(rows, counted):
        import pyarrow as pa
        block = _Block(rows, shards)
        counted = counted.sort_by("shard")
        n, t = (np.concatenate([_unpack(x) for x in counted[c].to_pylist()]).astype(np.float64) for c in ("n", "t"))
        target, background = block.losses(n, t)
        return pa.table({"_id": pa.array(block.ids, pa.string()), "n_tokens": block.lengths, "target_loss": target,
                         "background_loss": background})
    return run


def score_documents(df: DataFrame, targets: DataFrame | list, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Per row: id, ``n_tokens``, ``target_loss``, ``background_loss`` (nats per
    token) and ``score`` (their difference). ``targets`` has the target ids."""
    ship(df)
    kind = df.schema[id_col].dataType.simpleString()
    if not isinstance(targets, DataFrame):
        targets = df.sparkSession.createDataFrame([(i,) for i in targets], f"_target {kind}")
    size = df.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    blocks, shards = (max(1, -(-size // x)) for x in (block_chars, shard_chars))

    def dealt(*by):
        return F.pmod(F.xxhash64(F.coalesce(*by)), F.lit(blocks)).alias("block")

    name = F.col(id_col).cast("string")
    rows = df.select(dealt(name, F.col(text_col)), name.alias("_id"), F.col(text_col).alias("_text")).groupBy("block")
    wanted = F.col(targets.columns[0]).cast("string")
    ids = targets.where(wanted.isNotNull()).select(dealt(wanted), wanted.alias("_target"))
    sent = rows.cogroup(ids.groupBy("block")).applyInArrow(_cut(shards), SENT)
    counted = sent.groupBy("shard").applyInArrow(_count, COUNTED)
    out = rows.cogroup(counted.groupBy("block")).applyInArrow(_score(shards), SCORES)
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_tokens", "target_loss", "background_loss",
                      (F.col("target_loss") - F.col("background_loss")).alias("score"))
