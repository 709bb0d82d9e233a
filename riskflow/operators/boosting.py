"""Gradient boosting on the softmax loss, trees grown on histograms.

Features are binned once at quantiles of one pass, and the binned rows are
written as a table (a byte per feature) in blocks of up to ``BLOCK_ROWS`` rows, each
feature's bytes side by side: a pass receives a few byte strings per block, and adds
up one feature after the other in the processor's cache. A round grows one tree per class on the
same gradients. Each level of all of them is one pass: every task adds the
gradients and Hessians of its rows by (class, node, feature, bin), the sums of a
node meet in one task, which takes one partial sum after the other, and the
node's best split comes back to the driver as a row. Of two siblings only the lighter is
added up; the other's sums are their parent's less its own. Only bins that hold rows
travel, so a level moves at most ``tasks x nodes x features x bins`` sums,
whatever the rows, and the driver holds the model only.

Gradients are rounded to whole multiples of a power of two chosen from the total
weight, so sums are exact in any order: a lost task or another partitioning
gives the same trees from the same written table. Row draws hash the row's
number in that table. A round's trees are added to the rows' scores once, kept by
the executors for the passes of the next round (on disk where memory is short);
every ``STAGE_ROUNDS`` rounds the rows are written anew, which cuts the lineage.

Empty tables give trees of one leaf worth 0; a constant feature is never split;
equal gains go to the lower feature and bin.

The fitted model is relational: a row per (round, class, node).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import block_scans, ensure_package_on_workers, write_stage
from riskflow.states import STATES

__all__ = ["BoostedModel", "Tree", "quantile_cuts", "fit", "probabilities", "margins", "to_table", "from_table"]

MOST_BINS = 256             # a bin is a byte
STAGE_ROUNDS = 10           # rounds between two written tables of scores
LEAST_GAIN = 1e-6
CACHED_ROWS = 4096          # rows of a block that stays in the processor's cache
BLOCK_ROWS = 32_768         # rows of a written block: about 3.5 MB with 38 features
FILE_BLOCKS = 4             # blocks of a written file, which a task of a pass reads
BLOCK_NAMES = ["rid", "x", "y", "w", "m"]
MODEL_SCHEMA = ("round int, class string, node int, left int, right int, position int, feature string, "
                "threshold double, value double, cover double")


@dataclass
class Tree:
    """Nodes in order of growth; ``left`` is -1 at a leaf. A row goes left where
    its feature is at most the threshold (its bin at most ``bin``)."""
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [1.0])

    def split(self, node: int, feature: int, at: int, threshold: float) -> tuple[int, int]:
        n = len(self.left)
        self.left[node], self.right[node] = n, n + 1
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        for column, empty in ((self.left, -1), (self.right, -1), (self.feature, 0), (self.bin, 0),
                              (self.threshold, 0.0), (self.value, 0.0), (self.cover, 0.0)):
            column += [empty, empty]
        return n, n + 1

    def leaves(self, x: np.ndarray, bounds: list) -> np.ndarray:
        """The node each row of ``x`` ends in; ``bounds`` is ``bin`` or ``threshold``."""
        left, right = np.asarray(self.left), np.asarray(self.right)
        feature, bound = np.asarray(self.feature), np.asarray(bounds)
        own = np.arange(len(left))                      # a leaf leads to itself
        child = np.column_stack([np.where(left < 0, own, left), np.where(left < 0, own, right)]).ravel()
        out = np.zeros(len(x), np.int64)
        for begin in range(0, len(x), CACHED_ROWS):
            part = np.ascontiguousarray(x[begin:begin + CACHED_ROWS])
            flat, start, at = part.ravel(), np.arange(len(part)) * x.shape[1], out[begin:begin + CACHED_ROWS]
            while True:
                right_ = ~(flat[start + feature[at]] <= bound[at])
                to = child[2 * at + right_]
                if (to == at).all():
                    break
                at[:] = to
        return out


@dataclass
class BoostedModel:
    features: list[str]
    rounds: list[list[Tree]]        # a tree per class and round

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Scores of raw feature rows, a column per class."""
        out = np.zeros((len(x), len(STATES)))
        for trees in self.rounds:
            for c, t in enumerate(trees):
                out[:, c] += np.asarray(t.value)[t.leaves(x, t.threshold)]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def drawn(rid: np.ndarray, number: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round draws: a hash of the row's number, the round and the seed."""
    z = rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + number) % (1 << 63))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * 2.0 ** 53


def columns_of(number: int, cls: int, seed: int, share: float, n: int) -> np.ndarray:
    """The features a tree may split on."""
    return np.sort(np.random.default_rng([seed, number, cls]).permutation(n)[:max(1, int(share * n))])


def gradients(score: np.ndarray, y: np.ndarray, w: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives per class in whole multiples of ``1 / scale``."""
    p = softmax(score)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1.0
    h = np.maximum(2.0 * p * (1.0 - p), 1e-16)
    return np.rint(g * w[:, None] * scale), np.rint(h * w[:, None] * scale)


def best_split(sums: np.ndarray, allowed: np.ndarray, penalty: float, least_weight: float):
    """``(gain, feature, bin, GL, HL)`` of one node from its ``[feature, bin, 2]``
    sums, None where no split is worth it."""
    total = sums[allowed[0]].sum(axis=0)
    left = sums[allowed].cumsum(axis=1)[:, :-1]
    right = total - left
    if not left.shape[1]:
        return None
    gain = (left[..., 0] ** 2 / (left[..., 1] + penalty) + right[..., 0] ** 2 / (right[..., 1] + penalty)
            - total[0] ** 2 / (total[1] + penalty))
    gain[(left[..., 1] < least_weight) | (right[..., 1] < least_weight) | (right[..., 1] <= 0)] = -1.0
    k = int(gain.argmax())
    f, b = divmod(k, gain.shape[1])
    if gain[f, b] <= LEAST_GAIN:
        return None
    return float(gain[f, b]), int(allowed[f]), b, float(left[f, b, 0]), float(left[f, b, 1])


def quantile_cuts(table: DataFrame, features: list[str], bins: int = MOST_BINS) -> list[np.ndarray]:
    """Upper borders of all bins but the last, from one aggregate over the table."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must lie between 2 and {MOST_BINS}")
    shares = [i / bins for i in range(1, bins)]
    found = table.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, max(10_000, 50 * bins)).alias(f"q{i}")
                        for i, f in enumerate(features)]).first()
    return [np.unique(np.asarray(q if q else [], dtype=float)) for q in found]


def _numbers(column, dtype, width: int) -> np.ndarray:
    """Rows of ``width`` numbers from a column of equally long byte strings, where they lie."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty((0, width), dtype)
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(dtype).reshape(-1, width)


def _binned(table: DataFrame, features: list[str], cuts: list[np.ndarray], weight: str | None) -> DataFrame:
    """Blocks of rows as bytes (features one after the other), with the rows' numbers,
    labels, weights and scores, written once."""
    k, width = len(STATES), len(cuts)

    def block(held: list) -> list:
        import pyarrow as pa
        x, y, w, rid = (np.concatenate(parts, axis=-1) for parts in zip(*held))
        return [pa.array([v.tobytes()], pa.binary()) for v in (rid, x, y, w, np.zeros((len(y), k)))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held, n = [], 0
        for b in batches:
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y, w, rid = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for begin in range(0, len(y), BLOCK_ROWS):
                part = slice(begin, begin + BLOCK_ROWS)
                x = np.empty((width, len(y[part])), np.uint8)
                for i, c in enumerate(cuts):
                    x[i] = np.searchsorted(c, rows[part, i], side="left")
                if n and n + x.shape[1] > BLOCK_ROWS:
                    yield pa.RecordBatch.from_arrays(block(held), names=BLOCK_NAMES)
                    held, n = [], 0
                held.append((x, y[part].astype(np.int32), w[part].astype(np.float64), rid[part].astype(np.int64)))
                n += x.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays(block(held), names=BLOCK_NAMES)

    rows = table.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                        F.col("label").cast("int").alias("y"),
                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                        F.monotonically_increasing_id().alias("rid"))
    return write_stage(rows.mapInArrow(run, ", ".join(f"{n} binary" for n in BLOCK_NAMES)), "binned",
                       maxRecordsPerFile=FILE_BLOCKS)


def _arrays(b, width: int) -> Iterator:
    """Of every block of a batch: row numbers, features [feature, row], labels, weights, scores [row, class]."""
    for i in range(b.num_rows):
        rid, x, y, w, m = (_numbers(b.column(c).slice(i, 1), t, 1).ravel()
                           for c, t in enumerate((np.int64, np.uint8, np.int32, np.float64, np.float64)))
        yield rid, x.reshape(width, -1), y, w, m.reshape(-1, len(STATES))


def _weight(rows: DataFrame) -> float:
    """The sum of the rows' weights."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_numbers(b.column(0).slice(i, 1), np.float64, 1).sum()
                                                        for i in range(b.num_rows)], pa.float64())], names=["w"])
    return rows.select("w").mapInArrow(run, "w double").agg(F.sum("w")).first()[0] or 0.0


def _scored(rows: DataFrame, newer: list[list[Tree]], n_features: int) -> DataFrame:
    """The binned table with the newer trees added to its scores."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            m = [_add(score.copy(), np.ascontiguousarray(x.T), newer).tobytes() for _, x, _, _, score in _arrays(b, n_features)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(m, pa.binary())], names=BLOCK_NAMES)

    return rows.mapInArrow(run, rows.schema)


def _add(score: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for trees in rounds:
        for c, t in enumerate(trees):
            score[:, c] += np.asarray(t.value)[t.leaves(x, t.bin)]
    return score


def _level(rows: DataFrame, growing: list[Tree], frontier: list[tuple[int, int, int, int]], above: DataFrame | None,
           columns: list[np.ndarray], bins: int, number: int, scale: float, params: dict) -> DataFrame:
    """One pass: per open (class, node) its sums and best split. ``frontier`` lists (class,
    parent, node, its sibling): rows are added up for the node, the sibling's sums are what
    is left of the parent's, which ``above`` holds from the pass before; sums are whole
    numbers, so that is exact. A root has neither parent nor sibling (-1)."""
    k, width = len(STATES), len(params["widths"])
    offset = np.concatenate([[0], np.cumsum(params["widths"])]).astype(np.int64)
    size = int(offset[-1])
    slot, pairs = {}, {}
    for c, parent, node, sibling in frontier:
        slot.setdefault(c, {})[node] = len(slot.get(c, {}))
        pairs[c, parent] = node, sibling
    parents = {(c, node): parent for c, parent, node, _ in frontier}

    def packed(part: np.ndarray) -> tuple[bytes, bytes]:
        held = np.flatnonzero(part.any(axis=0))
        return held.astype(np.int32).tobytes(), part[:, held].tobytes()

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        widths = params["widths"]
        sums = {c: {f: np.zeros((2, len(s) * widths[f])) for f in columns[c]} for c, s in slot.items()}
        seen = False
        for b in batches:
            for rid, x, y, w, score in _arrays(b, width):
                take = drawn(rid, number, params["seed"], params["subsample"])
                if not take.any():
                    continue
                seen = True
                x = x[:, take]
                lying = np.ascontiguousarray(x.T)
                g, h = gradients(score[take], y[take], w[take], scale)
                for c, places in slot.items():
                    at = np.full(len(growing[c].left), -1)
                    for node, place in places.items():
                        at[node] = place
                    place = at[growing[c].leaves(lying, growing[c].bin)]
                    here = np.flatnonzero(place >= 0)
                    if not len(here):
                        continue
                    place, own = place[here], (x if len(here) == len(place) else x[:, here])
                    parts = [np.ascontiguousarray(d[here, c]) for d in (g, h)]
                    key = np.empty_like(place)
                    for f in columns[c]:
                        np.multiply(place, widths[f], out=key)
                        key += own[f]
                        for i, d in enumerate(parts):
                            sums[c][f][i] += np.bincount(key, d, len(places) * widths[f])
        if seen:
            for c, places in slot.items():
                whole = np.zeros((2, len(places), size))
                for f in columns[c]:
                    whole[:, :, offset[f]:offset[f + 1]] = sums[c][f].reshape(2, len(places), -1)
                for node, place in places.items():
                    part = whole[:, place]
                    held, sent = packed(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], pa.int32()), pa.array([parents[c, node]], pa.int32()), pa.array([False]),
                         pa.array([held], pa.binary()), pa.array([sent], pa.binary())], names=["c", "node", "whole", "held", "sums"])

    def choose(batches: Iterator) -> Iterator:
        import pyarrow as pa
        found: dict[tuple[int, int], np.ndarray] = {}
        whole_of: dict[tuple[int, int], np.ndarray] = {}
        feature = np.repeat(np.arange(width), params["widths"])
        for b in batches:
            for c, parent, is_whole, held, part in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (c, parent) in pairs:
                    sums = (whole_of if is_whole else found).setdefault((c, parent), np.zeros((2, size)))
                    sums[:, np.frombuffer(held, np.int32)] += np.frombuffer(part).reshape(2, -1)
        open_ = {}
        for (c, parent), sums in found.items():
            node, sibling = pairs[c, parent]
            open_[c, node] = sums
            if sibling >= 0:
                open_[c, sibling] = whole_of[c, parent] - sums
        out = []
        for (c, node), flat in sorted(open_.items(), key=lambda x: x[0]):
            whole = np.zeros((width, bins, 2))       # features with fewer bins end in empty ones
            whole[feature, np.arange(size) - offset[feature]] = flat.T / scale
            total = whole[columns[c][0]].sum(axis=0)
            best = best_split(whole, columns[c], params["penalty"], params["least_weight"])
            out.append((c, node, float(total[0]), float(total[1]), *(best or (0.0, -1, 0, 0.0, 0.0)),
                        *(packed(flat) if best else (b"", b""))))
        if out:
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(),
                     pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)],
                                             names=["c", "node", "g", "h", "gain", "feature", "at", "gl", "hl", "held", "sums"])

    schema = "c int, node int, whole boolean, held binary, sums binary"
    parts = rows.mapInArrow(add, schema)
    if above is not None:
        parts = parts.unionByName(above.select("c", "node", F.lit(True).alias("whole"), "held", "sums"))
    # few rows, kept for the next pass: a task for every core, or node where these are fewer
    tasks = min(len(frontier), rows.sparkSession.sparkContext.defaultParallelism)
    return parts.repartition(tasks, "c", "node").mapInArrow(
        choose, "c int, node int, g double, h double, gain double, feature int, at int, gl double, hl double, "
                "held binary, sums binary")


def fit(table: DataFrame, features: list[str], rounds: int = 300, depth: int = 6, learning_rate: float = 0.1,
        subsample: float = 0.8, colsample: float = 0.8, bins: int = MOST_BINS, penalty: float = 1.0,
        least_weight: float = 1.0, seed: int = 42, weight: str | None = "weight",
        cuts: list[np.ndarray] | None = None) -> BoostedModel:
    """Fit from a training table (features, ``label``, weight)."""
    ensure_package_on_workers(table.sparkSession)
    cuts = quantile_cuts(table, features, bins) if cuts is None else cuts
    rows = _binned(table, features, cuts, weight)
    with block_scans(table.sparkSession):
        return _grown(rows, features, cuts, rounds, depth, learning_rate, subsample, colsample, penalty, least_weight, seed)


def _grown(rows: DataFrame, features: list[str], cuts: list[np.ndarray], rounds: int, depth: int, learning_rate: float,
           subsample: float, colsample: float, penalty: float, least_weight: float, seed: int) -> BoostedModel:
    """The trees of all rounds from the binned blocks."""
    widths = [len(c) + 1 for c in cuts]
    total = _weight(rows) or 1.0
    scale = 2.0 ** min(30, 50 - int(np.ceil(np.log2(max(total, 1.0)))))     # all sums stay below 2 ** 53
    params = {"widths": widths, "seed": seed, "subsample": subsample, "penalty": penalty, "least_weight": least_weight}

    def leaf(g, h):
        return -g / (h + penalty) * learning_rate

    done: list[list[Tree]] = []
    kept: list[DataFrame] = []      # this round's scores and those they are made from
    for number in range(rounds):
        if number:
            rows = _scored(rows, done[-1:], len(features))
            if number % STAGE_ROUNDS == 0:
                rows = write_stage(rows, "scored", maxRecordsPerFile=FILE_BLOCKS)
                while kept:
                    kept.pop().unpersist()
            else:
                kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        trees = [Tree() for _ in STATES]
        columns = [columns_of(number, c, seed, colsample, len(features)) for c in range(len(STATES))]
        frontier = [(c, -1, 0, -1) for c in range(len(STATES))]
        above = None
        for _ in range(depth):
            level = _level(rows, trees, frontier, above, columns, max(widths), number, scale, params) \
                .persist(StorageLevel.MEMORY_AND_DISK)      # the next pass needs its sums
            found = level.drop("held", "sums").collect()      # one row per open node
            if above is not None:
                above.unpersist()
            above, frontier = level, []
            for r in sorted(found, key=lambda r: (r.c, r.node)):
                t = trees[r.c]
                t.value[r.node], t.cover[r.node] = leaf(r.g, r.h), r.h
                if r.feature < 0:
                    continue
                low, high = t.split(r.node, r.feature, r["at"], float(cuts[r.feature][r["at"]]))
                t.value[low], t.cover[low] = leaf(r.gl, r.hl), r.hl
                t.value[high], t.cover[high] = leaf(r.g - r.gl, r.h - r.hl), r.h - r.hl
                frontier.append((r.c, r.node, *((low, high) if t.cover[low] <= t.cover[high] else (high, low))))
            if not frontier:
                break
            if len(kept) > 1:       # the first pass has read the scores before
                kept.pop(0).unpersist()
        if above is not None:
            above.unpersist()
        done.append(trees)
    while kept:
        kept.pop().unpersist()
    return BoostedModel(list(features), done)


def margins(df: DataFrame, model: BoostedModel):
    """An array column with the score of each class."""
    ensure_package_on_workers(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.margins(x.to_numpy(dtype=float))))

    return score(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(model.features)]))


def probabilities(df: DataFrame, model: BoostedModel, names: list[str]) -> DataFrame:
    """``df`` with one probability column per class."""
    d = df.withColumn("_z", margins(df, model))
    d = d.withColumn("_z", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))))
    total = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x)
    return d.select(*df.columns, *[(F.col("_z")[i] / total).alias(n) for i, n in enumerate(names)])


def to_table(model: BoostedModel, spark: SparkSession) -> DataFrame:
    rows = [(n, STATES[c], i, t.left[i], t.right[i], t.feature[i], model.features[t.feature[i]], t.threshold[i],
             t.value[i], t.cover[i])
            for n, trees in enumerate(model.rounds) for c, t in enumerate(trees) for i in range(len(t.left))]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def from_table(table: DataFrame, features: list[str]) -> BoostedModel:
    """The model of :func:`to_table`'s rows (as many as it has nodes)."""
    rounds: list[list[Tree]] = []
    for r in table.orderBy("round", "class", "node").collect():
        while len(rounds) <= r.round:
            rounds.append([Tree([], [], [], [], [], [], []) for _ in STATES])
        t = rounds[r.round][STATES.index(r["class"])]
        for column, v in ((t.left, r.left), (t.right, r.right), (t.feature, r.position), (t.bin, 0),
                          (t.threshold, r.threshold), (t.value, r.value), (t.cover, r.cover)):
            column.append(v)
    return BoostedModel(list(features), rounds)
