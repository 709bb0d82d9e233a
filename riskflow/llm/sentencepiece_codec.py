"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked as the model asks (a leading blank, blanks as U+2581) and cut
into words before each run of marks; no piece of the vocabulary crosses such a
cut (checked when the model is read), so words are segmented alone. The
distinct words of a batch are sorted, which lays them out as the leaves of a
trie in depth-first order: the forward states of the characters a word shares
with its predecessor are still on the stack and only the rest is computed.

The forward state of a prefix is the last piece of its best segmentation, with
its score. For a unigram model the best path maximises the sum of scores. For
a BPE model the path must be the one the merge order leads to: the last piece
of a prefix is the one piece that may stand after the best segmentation of what
precedes it, i.e. merging the two pieces' characters yields just these two
pieces. Segmentations of prefixes are prefixes of segmentations, so this one
state per character is exact, and the result equals the model's own encoder.
Runs of marks are the exception: their pieces all have one score, so merging is
not ordered by piece; words with such a run are merged directly.

Characters without a piece become byte pieces. Decoding joins pieces, turns
marks into blanks and drops the leading one.

The model is read once by the driver (its path is a parameter) and sent to the
workers; its size is that of the vocabulary. A worker keeps a bounded table of
words already segmented. No shuffle.

Defined cases: a null or empty text has no tokens and decodes to the empty
text. A text holding U+2581 itself decodes to a blank there, as in the model's
own decoder; ``round_trip`` is false then. Any length of text or word is
processed whole. Rows are independent: repeated rows give equal results; only
id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship, slices

__all__ = ["MODEL_PATH", "Model", "read_model", "Segmenter", "encode", "decode", "round_trip"]

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 200_000
CACHE_PAIRS = 300_000
CHUNK_CHARS = 1_000_000
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


class Model(NamedTuple):
    """The part of a model that encoding and decoding need."""
    kind: int
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown_id: int
    pieces: list[bytes]      # what each id decodes to
    dummy_prefix: bool
    key: bytes               # of the model file's content


def read_model(path: str = MODEL_PATH) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        content = f.read()
    proto.ParseFromString(content)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("models that rewrite characters or drop blanks are not supported")
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    scores, ids, byte_ids, unknown, pieces = {}, {}, [-1] * 256, 0, []
    for k, p in enumerate(proto.pieces):
        if p.type in (NORMAL, USER_DEFINED):
            scores[p.piece], ids[p.piece] = p.score, k
            pieces.append(p.piece.replace(MARK, " ").encode())
        elif p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = k
            pieces.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            unknown = k if p.type == UNKNOWN else unknown
            pieces.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
        raise ValueError("a piece crosses a word boundary")
    return Model(proto.trainer_spec.model_type, scores, ids, byte_ids, unknown, pieces,
                 norm.add_dummy_prefix, hashlib.md5(content).digest())


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Segment by the merge order: again and again the best-scored adjacent
    pair (leftmost of equals) becomes one piece."""
    parts, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(parts):
            joined = parts[i] + parts[j]
            if joined in scores:
                heapq.heappush(heap, (-scores[joined], i, joined))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if not parts[i] or nxt[i] >= len(parts) or parts[i] + parts[nxt[i]] != joined:
            continue
        j = nxt[i]
        parts[i], parts[j], nxt[i] = joined, "", nxt[j]
        if nxt[j] < len(parts):
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [p for p in parts if p]


class Segmenter:
    """Segments sorted words, sharing the forward states of common prefixes."""

    def __init__(self, model: Model):
        self.model = model
        self.whole: dict[str, bool] = {}
        self.halves: dict[str, list[str]] = {}
        # segmented words in two generations: the older one is dropped when the younger is full
        self.words: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.steps = 0           # characters whose state was computed
        self.low = min(model.scores.values()) - 10.0
        # when a piece is merged: the lower the earlier; characters come before all
        self.rank = {p: -v for p, v in model.scores.items() if len(p) > 1}
        # pieces by number, and all pieces as a tree of characters; "" leads to the number
        self.names = list(model.scores)
        self.number = {p: k for k, p in enumerate(self.names)}
        self.value = list(model.scores.values())
        self.codes = [array("i", [model.ids[p]]) for p in self.names]
        self.root: dict = {}
        for k, p in enumerate(self.names):
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = k
        self.pairs: dict[int, bool] = {}      # by left number * 2^32 + right number

    def _character(self, c: str) -> int:
        """The number of a single character, which may have no piece."""
        k = self.number.get(c)
        if k is None:
            m = self.model
            coded = [m.byte_ids[b] for b in c.encode("utf-8", "replace")]
            k = self.number[c] = len(self.names)
            self.names.append(c)
            self.value.append(self.low)
            self.codes.append(array("i", coded if min(coded) >= 0 else [m.unknown_id]))
        return k

    def _is_whole(self, piece: str) -> bool:
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = len(piece) == 1 or merge(piece, self.model.scores) == [piece]
        return ok

    def _halves(self, piece: str) -> list[str]:
        """The two pieces whose merge makes ``piece``."""
        parts = self.halves.get(piece)
        if parts is None:
            rest = {piece[i:j]: self.model.scores[piece[i:j]] for i in range(len(piece))
                    for j in range(i + 1, len(piece) + 1) if j - i < len(piece) and piece[i:j] in self.model.scores}
            parts = self.halves[piece] = merge(piece, rest)
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces leaves these two. Undo
        their merges from the last one on: at no time may the pieces that touch
        at the border make a piece that is merged earlier, or at the same time
        and further left."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        a, b = self.names[left], self.names[right]
        rank, limit = self.rank, float("inf")
        ok = self._is_whole(a) and self._is_whole(b)
        while ok:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                ok = False
                break
            ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
            if ra > rb:
                limit, a = ra, self._halves(a)[-1]
            elif rb >= 0:
                limit, b = rb + 0.5, self._halves(b)[0]
            else:
                break
        self.pairs[left << 32 | right] = ok
        return ok

    def _forward(self, word: str, at: int, open_: list, last: list[int], begin: list[int], best: list[float]) -> None:
        """States after each character from ``at`` on: ``open_`` gets the places
        in the tree of the pieces under way, ``last`` the last piece, ``begin``
        where it begins, ``best`` its score (unigram models only)."""
        root, number, pairs, bpe = self.root, self.number, self.pairs, self.model.kind == BPE
        under_way = open_[at]
        for i in range(at, len(word)):
            c, moved, choice = word[i], [], None
            if not bpe:
                found = []
                for j, node in under_way:
                    node = node.get(c)
                    if node is not None:
                        moved.append((j, node))
                        if "" in node:
                            found.append((best[j] + self.value[node[""]], -j, node[""]))
                k = self._character(c)
                score, j, choice = max([*found, (best[i] + self.value[k], -i, k)])
                begin.append(-j)
                best.append(score)
            else:
                for j, node in under_way:
                    node = node.get(c)
                    if node is not None:
                        moved.append((j, node))
                        if choice is None:
                            k = node.get("")
                            if k is not None:
                                if j:
                                    left = last[j]
                                    ok = pairs.get(left << 32 | k)
                                    if ok is None:
                                        ok = self._may_follow(left, k)
                                else:
                                    ok = self._is_whole(self.names[k])
                                if ok:
                                    choice, start = k, j
                if choice is None:
                    # no longer piece fits: the character itself does
                    choice, start = number.get(c), i
                    if choice is None:
                        choice = self._character(c)
                begin.append(start)
            node = root.get(c)
            if node is not None:
                moved.append((i, node))
            open_.append(moved)
            last.append(choice)
            under_way = moved

    def learn(self, words: Iterable[str]) -> None:
        """Segment the words that are not in the table yet."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        table, older, new = self.words, self.older, []
        for w in words:
            if w not in table:
                known = older.get(w)
                if known is None:
                    new.append(w)
                else:
                    table[w] = known
        new.sort()
        bpe, codes = self.model.kind == BPE, self.codes
        before, open_, last, begin, best = "", [[]], [-1], [0], [0.0]
        for word in new:
            if bpe and MARK * 2 in word:
                out = array("i")
                for p in merge(word, self.model.scores):
                    out += codes[self._character(p)]
                table[word] = out
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            for stack in (open_, last, begin, best):
                del stack[shared + 1:]
            self._forward(word, shared, open_, last, begin, best)
            self.steps += len(word) - shared
            path, i = [], len(word)
            while i:
                path.append(last[i])
                i = begin[i]
            out = array("i")
            for k in reversed(path):
                out += codes[k]
            table[word] = out
            before = word

    def encode_flat(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """All token ids in a row and the number of tokens of each text."""
        ids, counts, at = array("i"), [], 0
        cut = _CUT.findall
        while at < len(texts):
            # some texts at a time, so that only their words are held
            marked, size = [], 0
            while at < len(texts) and size < CHUNK_CHARS:
                t = texts[at]
                at += 1
                if t:
                    size += len(t)
                    t = t.replace(" ", MARK)
                    marked.append(cut(MARK + t if self.model.dummy_prefix else t))
                else:
                    marked.append([])
            self.learn(set().union(*marked))
            table = self.words
            for ws in marked:
                begin = len(ids)
                for w in ws:
                    ids += table[w]
                counts.append(len(ids) - begin)
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, counts = self.encode_flat(texts)
        out, at = [], 0
        for n in counts:
            out.append(ids[at:at + n].tolist())
            at += n
        return out

    def decode(self, ids: Iterable[int]) -> str:
        pieces = self.model.pieces
        text = b"".join([pieces[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_SEGMENTERS: dict[bytes, Segmenter] = {}


def _segmenter(model: Model) -> Segmenter:
    """One per model and worker process, so its tables outlive a task."""
    if model.key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[model.key] = Segmenter(model)
    return _SEGMENTERS[model.key]


def _lists(ids: array, counts: list[int]):
    """An Arrow list per text over the flat ids."""
    import numpy as np
    import pyarrow as pa
    values = np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(values, pa.int32()))


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: id, ``token_ids``, ``n_tokens``."""
    spark = ship(df)
    model = spark.sparkContext.broadcast(read_model(model_path))  # the size of the vocabulary

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        seg = _segmenter(model.value)
        for batch in slices(batches):
            ids, counts = seg.encode_flat(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(ids, counts), pa.array(counts, pa.int64())],
                names=["_id", "token_ids", "n_tokens"])

    out = _columns(df, id_col, text_col).mapInArrow(
        run, f"_id {_id_type(df, id_col)}, token_ids array<int>, n_tokens bigint")
    return out.withColumnRenamed("_id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids",
           model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: id, ``text``. A null list decodes to the empty text."""
    spark = ship(df)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        seg = _segmenter(model.value)
        for batch in slices(batches):
            texts = [seg.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, f"_id {_id_type(df, id_col)}, text string").withColumnRenamed("_id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               model_path: str = MODEL_PATH) -> DataFrame:
    """Encode, decode what was encoded and compare: id, ``n_chars`` (code
    points), ``n_tokens``, ``token_ids``, ``decoded_sha256``, ``round_trip``."""
    spark = ship(df)
    model = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        seg = _segmenter(model.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = seg.encode_flat(texts)
            digests, same, at = [], [], 0
            for text, n in zip(texts, counts, strict=True):
                back = seg.decode(ids[at:at + n])
                at += n
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 _lists(ids, counts), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                names=["_id", "n_chars", "n_tokens", "token_ids", "decoded_sha256", "round_trip"])

    return _columns(df, id_col, text_col).mapInArrow(
        run, f"_id {_id_type(df, id_col)}, n_chars bigint, n_tokens bigint, token_ids array<int>, "
             "decoded_sha256 string, round_trip boolean").withColumnRenamed("_id", id_col)
