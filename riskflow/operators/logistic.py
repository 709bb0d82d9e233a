"""Multinomial logistic regression by Newton steps, kept as a small table.

Minimised is the sum over rows of weight x log loss plus ``|w|^2 / (2 C)`` over
the coefficients of the standardised features (intercepts are free), the
objective of the reference's solver. The objective is convex, so each step
solves for the second-order optimum: a pass over the written training table
adds up loss, gradient and Hessian, which have a fixed size of
``(classes x (features + 1))`` and its square whatever the rows, and the driver
solves that system. About ten passes take the place of hundreds of first-order
iterations. A step that raises the loss is halved.

The rows a fit needs are written once in blocks (features one after the other, as
compressed bytes), so that a pass hands a few short byte strings per block to Python and
not forty values per row. Rows stay where they are: a task sums the blocks of a file, files hold
like numbers of rows, and the sums meet by their place in the matrix. Of the Hessian,
which is symmetric and whose last class follows from the others, only the part that
is not repeated is sent.

The fitted model is relational: ``(class, feature, coefficient, mean, std)`` with
a row per class and feature and one per class for the intercept, so a join, or
another engine, can score from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import block_scans, ensure_package_on_workers, write_stage
from riskflow.states import STATES

__all__ = ["LinearModel", "packed", "label_weights", "statistics", "fit", "probabilities", "to_table", "from_table"]

INTERCEPT = "(intercept)"
MOST_STEPS = 100
HALVINGS = 12
CACHED_ROWS = 2048          # rows of a block that stays in the processor's cache
SENT = 1024                 # numbers of a task's sums in a row
BLOCK_CODEC = "lz4"         # noise hardly compresses: what unpacks fastest
FILE_BLOCKS = 64            # blocks of a written file, so tasks get even shares


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[list[float]]     # per class, of the standardised features
    intercepts: list[float]
    means: list[float]
    stds: list[float]                   # population, 1 where a feature is constant
    steps: int = 0
    loss: float = 0.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, second: bool):
    """Loss, gradient and Hessian (None without ``second``) of standardised rows with a column of ones."""
    k, q = theta.shape
    p = _softmax(x @ theta.T)
    loss = float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    r = p.copy()
    r[np.arange(len(y)), y] -= 1.0
    grad = (r * w[:, None]).T @ x
    if not second:
        return loss, grad, None
    hess, p = np.empty((k, q, k, q)), np.ascontiguousarray(p.T)
    lying = x.T
    scaled = np.empty(lying.shape)
    for a in range(k - 1):
        for b in range(a + 1):
            # a product with its own transpose takes half the work
            np.multiply(lying, np.sqrt(w * p[a] * (1.0 - p[a] if a == b else p[b])), out=scaled)
            block = scaled @ scaled.T
            hess[a, :, b, :] = hess[b, :, a, :] = block if a == b else -block
    _last_class(hess)
    return loss, grad, hess


def _last_class(hess: np.ndarray) -> None:
    """Probabilities add up to 1, so the blocks of a class do to 0: the last class's follow."""
    k = len(hess)
    for a in range(k - 1):
        hess[a, :, k - 1, :] = hess[k - 1, :, a, :] = -hess[a, :, :k - 1, :].sum(axis=1)
    hess[k - 1, :, k - 1, :] = -hess[k - 1, :, :k - 1, :].sum(axis=1)


def packed(table: DataFrame, features: list[str], weight: str | None = "weight") -> DataFrame:
    """The rows of a training table (features, ``label``, weight) in blocks of bytes, written once."""
    ensure_package_on_workers(table.sparkSession)
    n = len(features)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        codec = pa.Codec(BLOCK_CODEC)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            w = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            parts = [slice(at, at + CACHED_ROWS) for at in range(0, len(y), CACHED_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array([codec.compress(np.ascontiguousarray(v[p].T), asbytes=True) for p in parts],
                                                       pa.binary()) for v in (x, y, w)] +
                                             [pa.array([len(y[p]) for p in parts], pa.int32())], names=["x", "y", "w", "n"])

    rows = table.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("label").cast("int"),
                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    return write_stage(rows.mapInArrow(run, "x binary, y binary, w binary, n int"), "packed",
                       maxRecordsPerFile=FILE_BLOCKS, compression="none")


def _labels(y, n) -> np.ndarray:
    import pyarrow as pa
    return np.frombuffer(pa.Codec(BLOCK_CODEC).decompress(y.as_buffer(), 4 * n.as_py()), np.int32)


def label_weights(blocks: DataFrame) -> dict[int, float]:
    """L10's balanced weight ``n / (k * n_c)`` of every label, from the labels of the blocks."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            y, n = np.unique(np.concatenate([_labels(*v) for v in zip(*batch.columns)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64())], names=["y", "n"])

    with block_scans(blocks.sparkSession):
        found = blocks.select("y", "n").mapInArrow(run, "y int, n bigint").groupBy("y").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in found)
    return {r["y"]: total / (len(found) * r["n"]) for r in found}


def _weighted(y: np.ndarray, w: np.ndarray, weights: dict[int, float] | None) -> np.ndarray:
    """The rows' weights times those of their labels."""
    if not weights:
        return w
    labels = np.array(sorted(weights), np.int32)
    return w * np.array([weights[v] for v in labels.tolist()])[np.searchsorted(labels, y)]


def _blocks(batch, n: int) -> Iterator:
    """Features [feature, row], labels and weights of a batch's blocks."""
    import pyarrow as pa
    codec = pa.Codec(BLOCK_CODEC)
    for x, y, w, rows in zip(*batch.columns):
        size = 8 * rows.as_py()
        yield (np.frombuffer(codec.decompress(x.as_buffer(), n * size)).reshape(n, -1), _labels(y, rows),
               np.frombuffer(codec.decompress(w.as_buffer(), size)))


def merged(parts: list) -> tuple:
    """Rows, means and sums of squared deviations of all ``parts`` of these."""
    n, mean, square = parts[0]
    for n_, mean_, square_ in parts[1:]:
        apart = mean_ - mean
        mean = mean + apart * (n_ / (n + n_))
        square = square + square_ + apart ** 2 * (n * n_ / (n + n_))
        n += n_
    return n, mean, square


def statistics(blocks: DataFrame, n: int) -> tuple[list, list]:
    """L6's mean and population standard deviation of ``n`` features (nulls without
    rows): one row per task comes back. Deviations are taken from a row of the block,
    so a constant feature's are 0 exactly."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        parts = []
        for batch in batches:
            for x, _, _ in _blocks(batch, n):
                d = x - x[:, :1]
                mean = d.mean(axis=1)
                parts.append((x.shape[1], x[:, 0] + mean, ((d - mean[:, None]) ** 2).sum(axis=1)))
        if parts:
            rows, mean, square = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([mean], pa.list_(pa.float64())),
                                              pa.array([square], pa.list_(pa.float64()))], names=["n", "mean", "square"])

    with block_scans(blocks.sparkSession):
        found = blocks.mapInArrow(run, "n bigint, mean array<double>, square array<double>").collect()      # a row per task
    if not found:
        return [None] * n, [None] * n
    rows, mean, square = merged([(r["n"], np.array(r["mean"]), np.array(r["square"])) for r in found])
    return mean.tolist(), np.sqrt(square / rows).tolist()


def _triangles(k: int, q: int) -> tuple[list, tuple]:
    """The pairs of classes and the places of a block of the Hessian that the others follow from."""
    return [(a, b) for a in range(k - 1) for b in range(a + 1)], np.triu_indices(q)


def _whole(flat: np.ndarray, k: int, q: int) -> np.ndarray:
    """The Hessian from the parts that are not repeated."""
    pairs, upper = _triangles(k, q)
    hess = np.zeros((k, q, k, q))
    for (a, b), part in zip(pairs, flat.reshape(len(pairs), -1)):
        block = np.zeros((q, q))
        block[upper] = part
        block = block + np.triu(block, 1).T
        hess[a, :, b, :] = hess[b, :, a, :] = block
    _last_class(hess)
    return hess.reshape(k * q, k * q)


def _pass(blocks: DataFrame, mean: np.ndarray, std: np.ndarray, theta: np.ndarray, second: bool,
          weights: dict[int, float] | None = None):
    """``sums`` over all blocks."""
    k, q = theta.shape
    n = q - 1
    pairs, upper = _triangles(k, q)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        loss, grad, hess, total = 0.0, 0.0, 0.0, 0.0
        for batch in batches:
            for raw, y, w in _blocks(batch, n):
                w = _weighted(y, w, weights)
                x = np.ones((n + 1, len(y)))
                np.subtract(raw, mean[:, None], out=x[:n])
                x[:n] /= std[:, None]
                one = sums(x.T, y, w, theta, second)
                loss, grad, total = loss + one[0], grad + one[1], total + w.sum()
                hess = hess + one[2] if second else hess
        if np.ndim(grad):
            parts = [hess[a, :, b, :][upper] for a, b in pairs] if second else []
            flat = np.concatenate([[loss, total], grad.ravel(), *parts])
            begins = range(0, len(flat), SENT)
            yield pa.RecordBatch.from_arrays([pa.array(begins, pa.int32()),
                                              pa.array([flat[at:at + SENT].tobytes() for at in begins], pa.binary())], names=["at", "v"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[at] = found.get(at, 0.0) + np.frombuffer(v.as_buffer())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())],
                                             names=["at", "v"])

    schema, spark = "at int, v binary", blocks.sparkSession
    with block_scans(spark):
        found = blocks.mapInArrow(run, schema).repartition("at").mapInArrow(add, schema).collect()      # pieces of one matrix
    flat = np.zeros(2 + k * q + len(pairs) * len(upper[0]) * second)
    for r in found:
        part = np.frombuffer(r["v"])
        flat[r["at"]:r["at"] + len(part)] = part
    return flat[0], flat[2:2 + k * q].reshape(k, q), _whole(flat[2 + k * q:], k, q) if second else None, flat[1]


def minimise(evaluate, k: int, q: int, c: float, tol: float, most_steps: int) -> tuple[np.ndarray, float, int]:
    """Newton's method with step halving; ``evaluate(theta, second)`` gives the
    data's part and its total weight, to which ``tol`` relates the gradient."""
    penal = np.full((k, q), 1.0 / c)
    penal[:, -1] = 0.0
    theta, step = np.zeros((k, q)), 0
    loss, grad, hess, total = evaluate(theta, True)
    while step < most_steps:
        step += 1
        g = (grad + penal * theta).ravel()
        # the intercepts may all move together at no loss: least squares leaves that direction alone
        move = np.linalg.lstsq(hess + np.diag(penal.ravel()), -g, rcond=1e-12)[0].reshape(k, q)
        whole = loss + 0.5 * float((penal * theta ** 2).sum())
        size = 1.0
        for _ in range(HALVINGS):
            to = theta + size * move
            new = evaluate(to, True)
            if new[0] + 0.5 * float((penal * to ** 2).sum()) <= whole:
                break
            size /= 2.0
        else:
            return theta, whole, step          # no step along this line lowers the loss: rounding decides from here
        theta, (loss, grad, hess, total) = to, new
        left = whole - loss - 0.5 * float((penal * theta ** 2).sum())
        if float(np.abs(grad + penal * theta).max()) <= tol * total or left <= 1e-12 * abs(whole):
            break
    return theta, loss + 0.5 * float((penal * theta ** 2).sum()), step


def fit(blocks: DataFrame, features: list[str], mean: list[float], std: list[float], classes: int = len(STATES),
        c: float = 1.0, max_iter: int = 2000, tol: float = 1e-4, weights: dict[int, float] | None = None) -> LinearModel:
    """Fit from the blocks of :func:`packed` and their :func:`statistics`; ``weights`` of labels
    multiply those of the rows."""
    m, s = np.array(mean), np.array([x or 1.0 for x in std])
    theta, loss, steps = minimise(lambda t, second: _pass(blocks, m, s, t, second, weights),
                                  classes, len(features) + 1, c, tol, min(max_iter, MOST_STEPS))
    intercepts = theta[:, -1] - theta[:, -1].mean()
    return LinearModel(list(features), theta[:, :-1].tolist(), intercepts.tolist(), m.tolist(), s.tolist(), steps, loss)


def probabilities(df: DataFrame, model: LinearModel, names: list[str]) -> DataFrame:
    """``df`` with one probability column per class: expressions on its feature columns."""
    def logit(w, b) -> Column:
        terms = [(F.col(f) - F.lit(m)) / F.lit(s) * F.lit(x) for f, x, m, s in zip(model.features, w, model.means, model.stds)]
        return sum(terms[1:], terms[0]) + F.lit(b)
    z = [logit(w, b) for w, b in zip(model.coefficients, model.intercepts)]
    d = df.withColumn("_z", F.array(*z))
    d = d.withColumn("_z", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))))
    total = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x)
    return d.select(*df.columns, *[(F.col("_z")[i] / total).alias(n) for i, n in enumerate(names)])


def to_table(model: LinearModel, spark: SparkSession) -> DataFrame:
    rows = []
    for c, state in enumerate(STATES):
        rows += [(state, f, j, model.coefficients[c][j], model.means[j], model.stds[j]) for j, f in enumerate(model.features)]
        rows.append((state, INTERCEPT, len(model.features), model.intercepts[c], 0.0, 1.0))
    return spark.createDataFrame(rows, "class string, feature string, position int, coefficient double, mean double, std double")


def from_table(table: DataFrame) -> LinearModel:
    by = {s: [] for s in STATES}
    for r in table.orderBy("position").collect():       # classes x (features + 1) rows
        by[r["class"]].append(r)
    first = by[STATES[0]][:-1]
    return LinearModel([r.feature for r in first], [[r.coefficient for r in by[s][:-1]] for s in STATES],
                       [by[s][-1].coefficient for s in STATES], [r["mean"] for r in first], [r["std"] for r in first])
