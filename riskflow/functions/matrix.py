"""Small dense-matrix algebra as Spark higher-order-function expressions.

A k x k matrix is a packed ``array<array<double>>`` column (row-major, rows =
from-state). A probability vector is ``array<double>``. Every function returns
a Column, so a table with one matrix per group (portfolio, segment, stage)
is transformed row-wise on the executors: no matrix is collected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "identity", "matmul", "vecmat", "matpow", "powers_upto", "mat_get",
    "mat_inverse", "identity_like", "row_sums", "mat_has_null", "mat_round",
]


def identity(k: int) -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(k)])
                     for i in range(k)])


def _idx(k) -> Column:
    """0..k-1 for a Python int or a Column size (empty when k = 0)."""
    if isinstance(k, int):
        return F.sequence(F.lit(0), F.lit(k - 1))
    return F.filter(F.sequence(F.lit(0), k), lambda i: i < k)


def mat_get(m: Column, i, j) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    j = F.lit(j) if isinstance(j, int) else j
    return F.get(F.get(m, i), j)


def matmul(a: Column, b: Column, k=None) -> Column:
    """(a @ b)[i][j] = sum_t a[i][t] * b[t][j], summed t = 0..k-1 in order.
    Without ``k`` the shapes are read from the arrays (a: r x s, b: s x c)."""
    inner = k if k is not None else F.size(b)
    outer = k if k is not None else F.size(F.get(b, 0))
    return F.transform(a, lambda row: F.transform(
        _idx(outer), lambda j: F.aggregate(
            _idx(inner), F.lit(0.0),
            lambda acc, t: acc + F.get(row, t) * mat_get(b, t, j))))


def vecmat(v: Column, m: Column, k: int) -> Column:
    """Row vector times matrix."""
    return F.transform(_idx(k), lambda j: F.aggregate(
        _idx(k), F.lit(0.0), lambda acc, t: acc + F.get(v, t) * mat_get(m, t, j)))


def matpow(p: Column, n, k: int) -> Column:
    """P^n by repeated right-multiplication; n = 0 gives the identity."""
    n = F.lit(n) if isinstance(n, int) else n
    steps = F.array_repeat(F.lit(0), n.cast("int"))
    return F.aggregate(steps, identity(k), lambda acc, _x: matmul(acc, p, k))


def powers_upto(p: Column, n_max: int, k: int) -> Column:
    """Array [P^1, ..., P^n_max], each power computed once (O(n) products)."""
    init = F.struct(identity(k).alias("cur"),
                    F.array().cast("array<array<array<double>>>").alias("acc"))
    steps = F.array_repeat(F.lit(0), n_max)
    out = F.aggregate(
        steps, init,
        lambda s, _x: F.struct(matmul(s["cur"], p, k).alias("cur"),
                               F.concat(s["acc"], F.array(matmul(s["cur"], p, k))).alias("acc")))
    return out["acc"]


def row_sums(m: Column) -> Column:
    return F.transform(m, lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x))


def identity_like(m: Column) -> Column:
    k = F.size(m)
    return F.transform(_idx(k), lambda i: F.transform(
        _idx(k), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0))))


def mat_inverse(m: Column, k=None) -> Column:
    """Gauss-Jordan inverse without pivoting (I - Q of an absorbing chain is
    diagonally dominant, so no pivoting is needed). A zero pivot yields nulls,
    which callers report as singular. ``k`` may be omitted: the size is read
    from the array, so groups may have different transient sets."""
    if k is None:
        k = F.size(m)
        ident = identity_like(m)
    else:
        ident = identity(k)
    aug = F.transform(_idx(k), lambda i: F.concat(F.get(m, i), F.get(ident, i)))

    def eliminate(a, p):
        piv = F.get(F.get(a, p), p)
        prow = F.transform(F.get(a, p), lambda x: F.try_divide(x, piv))
        return F.transform(a, lambda row, i: F.when(
            i == p, prow).otherwise(
            F.transform(row, lambda x, j: x - F.get(row, p) * F.get(prow, j))))

    done = F.aggregate(_idx(k), aug, eliminate)
    kk = F.lit(k) if isinstance(k, int) else k
    return F.transform(done, lambda row: F.slice(row, kk + 1, kk))


def mat_has_null(m: Column) -> Column:
    return F.exists(F.flatten(m), lambda x: x.isNull())


def mat_round(m: Column, d: int) -> Column:
    return F.transform(m, lambda row: F.transform(row, lambda x: F.round(x, d)))
