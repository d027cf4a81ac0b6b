"""Whitening of embeddings by a bidiagonal qd solver.

Spark reduces the centred rows block by block to one triangle R (QR of the triangle so far and the next
rows, then a tree over the triangles).  R is as small as the dimension squared, so the rest runs on the
driver: Householder reflections make it bidiagonal, dqds finds its singular values to high relative
accuracy, and twisted factorisations of ``B'B - s^2`` give the singular vectors, the whitening directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = float(np.finfo(np.float64).eps)
SCALE, SHIFT = 1024, 100_000
#: Entries of x beyond this size could not be summed exactly in 64 bits; their rows count as not finite.
LARGEST = float(1 << 50)
#: Triangles that one task of the tree joins, rows of a block of the first QR.
FAN_IN, BLOCK_ROWS = 256, 8192
#: Off-diagonal entries of this size, relative to the diagonal, part a bidiagonal matrix.
NEGLIGIBLE = (100 * EPS) ** 2
#: Neighbouring eigenvalues closer than this, relative to the larger, count as one cluster.
CLUSTER_GAP = 1e-3


# --- the solver: small matrices only ---------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with ``r = U B V'``, by Householder reflections from both sides."""
    a = np.array(r, np.float64)
    n = a.shape[1]
    v = np.eye(n)

    def mirror(x):
        """Unit w so that x - 2 w (w'x) has zeros behind its first entry; None where it has them already."""
        scale = np.abs(x).max(initial=0.0)
        if not np.abs(x[1:]).max(initial=0.0) > 0:
            return None
        w = x / scale
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        if (w := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < n - 1 and (w := mirror(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step with a shift; the third list holds its d values."""
    n = len(q)
    d = q[0] - shift
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    ds[0] = d
    for k in range(n - 1):
        s = d + e[k]
        new_q[k] = s
        ratio = q[k + 1] / s if s != 0.0 else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if s != 0.0 else q[k + 1] - shift
        ds[k + 1] = d
    new_q[n - 1] = d
    return new_q, new_e, ds


def _block_values(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of one bidiagonal block, by dqds with the better of two bounds as shift.

    A sweep without shift has 1/d_k as the diagonal of the inverse of B B', so that 1 / sum(1/d_k) bounds the
    least eigenvalue from below; rows of B with small neighbours bound the least singular value as well, which
    is the sharper bound in a cluster.  The shifts that are taken off add up in ``taken``.
    """
    found, taken, idle = [], 0.0, 0
    while q:
        if len(q) == 1:
            found.append(q[0] + taken)
            break
        if e[-1] <= NEGLIGIBLE * (q[-1] + taken):
            found.append(max(q.pop(), 0.0) + taken)
            e.pop()
            idle = 0
            continue
        split = [k for k in range(len(e) - 1) if e[k] <= NEGLIGIBLE * (min(q[k], q[k + 1]) + taken)]
        if split:
            k = split[-1] + 1
            found += [x + taken for x in _block_values(q[k:], e[k:])]
            q, e = q[:k], e[:k - 1]
            continue
        if q[0] < q[-1] * 0.25:  # the small end belongs where values leave: the mirrored transpose has the same values
            q, e = q[::-1], e[::-1]
        idle += 1
        if idle > 40 * len(q) + 400:
            raise ArithmeticError("dqds did not settle")
        plain_q, plain_e, d = _sweep(q, e, 0.0)
        if min(d) <= 0.0:
            q, e = plain_q, plain_e
            continue
        q, e = plain_q, plain_e
        side = [0.0, *(math.sqrt(x) for x in e), 0.0]
        by_rows = min(math.sqrt(x) - (side[k] + side[k + 1]) / 2 for k, x in enumerate(q))
        shift = max(1.0 / sum(1.0 / x for x in d), by_rows * by_rows if by_rows > 0 else 0.0)
        while shift > EPS * taken * 0.25:
            next_q, next_e, d = _sweep(q, e, shift)
            if min(d) >= 0.0:
                q, e, taken = next_q, next_e, taken + shift
                break
            shift *= 0.75
    return found


def _blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of B that no superdiagonal entry joins: entries that are zero to working precision part it."""
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = [0, *(k + 1 for k in range(len(b)) if abs(b[k]) <= EPS * 1e-3 * size), len(a)]
    return [(s, t) for s, t in zip(cuts, cuts[1:], strict=False) if t > s]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stationary and progressive factors of ``B'B - value``: multipliers from above and below, their pivots."""
    n = len(a)
    diag = a * a
    diag[1:] += b * b
    off = a[:-1] * b
    tiny = EPS * EPS * max(float(np.abs(diag).max()), 1e-300)
    down, up = np.empty(n), np.empty(n)
    # differential forms: s and p are the pivots without the part that cancels
    s = -value
    for k in range(n):
        down[k] = a[k] * a[k] + s
        if down[k] == 0.0:
            down[k] = tiny
        if k < n - 1:
            s = b[k] * b[k] * (s / down[k]) - value
    p = a[n - 1] * a[n - 1] - value
    for k in range(n - 1, -1, -1):
        above = b[k - 1] * b[k - 1] if k else 0.0
        up[k] = above + p
        if up[k] == 0.0:
            up[k] = tiny
        if k:
            p = a[k - 1] * a[k - 1] * (p / up[k]) - value
    return down, up, diag - value, off


def _vector(a: np.ndarray, b: np.ndarray, value: float, against: list[np.ndarray], nth: int) -> np.ndarray:
    """Unit eigenvector of ``B'B`` for ``value``: the twisted factorisation with the least pivot, solved for
    its twist; inside a cluster it is refined against the vectors that are there."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    down, up, rest, off = _twisted(a, b, value)
    # pivot of the twist at k: what is left of the entry after both sides are eliminated
    twist = down + up - rest
    below, above = off / down[:-1], off / up[1:]

    def solved(rhs, r):
        """The system of the factorisation that is twisted at r."""
        y, z = rhs.copy(), np.empty(n)
        for k in range(r):
            y[k + 1] -= below[k] * y[k]
        for k in range(n - 2, r - 1, -1):
            y[k] -= above[k] * y[k + 1]
        z[r] = y[r] / (twist[r] if twist[r] != 0.0 else EPS * EPS * max(float(np.abs(rest).max()), 1e-300))
        for k in range(r - 1, -1, -1):
            z[k] = y[k] / down[k] - below[k] * z[k + 1]
        for k in range(r + 1, n):
            z[k] = y[k] / up[k] - above[k - 1] * z[k - 1]
        return z

    def apart(z):
        for _ in range(2):
            for x in against:
                z = z - x * (x @ z)
        size = np.linalg.norm(z)
        return z / size if size > 0 else z

    r = int(np.argsort(np.abs(twist), kind="stable")[0])
    start = np.zeros(n)
    start[r] = twist[r] if twist[r] != 0.0 else 1.0
    z = solved(start, r)
    z = apart(z / np.abs(z).max())
    if against:  # vectors of a cluster share the large entries; a few steps from other starts part them
        start = np.cos(np.arange(1, n + 1) * (nth + 1.0))
        z = apart(z + 1e-3 * start / np.linalg.norm(start))
        for _ in range(4):
            z = solved(z, r)
            z = apart(z / np.abs(z).max())
    return z


def singular_pairs(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, largest first; the first ``count`` right singular vectors as columns) of a square matrix."""
    a, b, v = bidiagonal(r)
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    n = len(a)
    if not size:
        return np.zeros(n), v[:, :count]
    a, b = a / size, b / size
    pairs = []
    for s, t in _blocks(a, b):
        pairs += [(x, s, t) for x in _block_values((a[s:t] ** 2).tolist(), (b[s:t - 1] ** 2).tolist())]
    pairs.sort(key=lambda p: (-p[0], p[1]))
    values = np.array([max(p[0], 0.0) for p in pairs])
    vectors = np.zeros((n, count))
    mates: dict[tuple[int, int], list[tuple[float, np.ndarray]]] = {}
    for k, (x, s, t) in enumerate(pairs[:count]):
        near = mates.setdefault((s, t), [])
        if near and abs(near[-1][0] - x) > CLUSTER_GAP * max(x, near[-1][0]):
            near.clear()
        z = _vector(a[s:t], b[s:t - 1], x, [own for _, own in near], k)
        near.append((x, z))
        vectors[s:t, k] = z
    return np.sqrt(values) * size, v @ vectors


# --- the distributed part ----------------------------------------------------------

def _whole(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their x as exact doubles) of the vectors without null and non-finite entries, by length."""
    lists = batch.column(column)
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    flat = np.asarray(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        x = np.floor(flat[begins[rows][:, None] + np.arange(size)] * SCALE) + SHIFT
        good = (np.abs(x) < LARGEST).all(axis=1)  # false for NaN as well
        yield rows[good], x[good]


@dataclass
class Fit:
    """What the rows are whitened with: their number and exact sums, directions and scales."""

    n: int
    sums: list[int]
    directions: np.ndarray
    scales: np.ndarray
    explained: np.ndarray


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    kind = rows.schema[vector].dataType
    kept = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return rows if kept else rows.withColumn(vector, F.col(vector).cast("array<double>"))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and per-dimension sums of x of the vectors of the commonest length (of equals, the largest)."""
    def run(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at, x in _whole(batch, 0):
                if len(at):
                    n, s = held.get(x.shape[1], (0, 0))
                    held[x.shape[1]] = (n + len(at), s + x.astype(np.int64).sum(axis=0))
        yield pa.RecordBatch.from_pydict({"dim": [*held], "n": [n for n, _ in held.values()], "s": [s.tolist() for _, s in held.values()]},
                                         pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    parts = rows.mapInArrow(run, "dim int, n long, s array<long>")
    totals = parts.groupBy("dim").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return 0, []
    whole = parts.where(F.col("dim") == top["dim"]).select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return top["n"], [int(r["v"]) for r in whole.orderBy("at").collect()]


def _means(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as a whole part and a rest, so that x - S/n is right to the last bits."""
    whole = [s // n for s in sums]
    return np.array(whole, np.float64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _centred(batch: pa.RecordBatch, column: int, means: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, x, x - S/n) of the vectors with the length of the fit."""
    for at, x in _whole(batch, column):
        if x.shape[1] == len(means[0]):
            return at, x, (x - means[0]) - means[1]
    return np.zeros(0, np.int64), np.zeros((0, len(means[0]))), np.zeros((0, len(means[0])))


def _triangle(rows: DataFrame, means: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d = len(means[0])

    def reduced(parts) -> np.ndarray:
        r = np.zeros((0, d))
        for part in parts:
            for k in range(0, len(part), BLOCK_ROWS):
                r = np.linalg.qr(np.concatenate([r, part[k:k + BLOCK_ROWS]]), mode="r")
        return r

    def first(batches):
        task = TaskContext.get().partitionId()
        r = reduced(_centred(b, 0, means)[2] for b in batches)
        if len(r):
            yield pa.RecordBatch.from_pydict({"task": [task], "r": [r.astype("<f8").tobytes()]}, pa.schema([("task", pa.int32()), ("r", pa.binary())]))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("task")
        r = reduced(np.frombuffer(x, "<f8").reshape(-1, d) for x in ordered["r"])
        return pd.DataFrame({"task": [int(ordered["task"].iloc[0]) // FAN_IN], "r": [r.astype("<f8").tobytes()]})

    level = rows.mapInArrow(first, "task int, r binary")
    for _ in range(2):  # FAN_IN triangles a task, then what is left of them
        level = level.groupBy(F.expr(f"task div {FAN_IN}")).applyInPandas(joined, "task int, r binary")
    last = [np.frombuffer(row["r"], "<f8").reshape(-1, d) for row in level.orderBy("task").collect()]
    r = reduced(last)
    return np.concatenate([r, np.zeros((d - len(r), d))])


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Fit | None:
    """Number, exact sums and whitening directions of all vectors; None where there is nothing to fit.

    Directions without variance (to working precision) are left out: no scale could make them white.
    """
    own = _vectors(rows.select(F.col(vector).alias("vector")), "vector")
    n, sums = _sums(own)
    if not n:
        return None
    values, directions = singular_pairs(_triangle(own, _means(n, sums)), min(components, len(sums)))
    e = values ** 2 / n
    kept = int((values[:components] > values.max(initial=0.0) * EPS * len(sums) * 8).sum())
    if not kept:
        return None
    return Fit(n, sums, directions[:, :kept], np.sqrt(e[:kept]), e[:kept] / e.sum())


def _identity_error(rows: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured on the rows."""
    means, width = _means(fitted.n, fitted.sums), len(fitted.scales)

    def run(batches):
        n, mean, squares = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = _centred(batch, 0, means)[2] @ fitted.directions / fitted.scales
            if len(y):  # counts, means and centred products of two parts
                own, m = len(y), y.mean(axis=0)
                squares += (y - m).T @ (y - m) + np.outer(m - mean, m - mean) * (n * own / (n + own))
                mean, n = mean + (m - mean) * (own / (n + own)), n + own
        # products about zero again, which add up over the tasks: the mean of all whitened rows is zero but for rounding
        yield pa.RecordBatch.from_pydict({"at": list(range(width * (width + 1))), "v": [*(squares + n * np.outer(mean, mean)).ravel().tolist(), *(n * mean).tolist()]},
                                         pa.schema([("at", pa.int32()), ("v", pa.float64())]))

    totals = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    v = np.array([r["v"] for r in totals.orderBy("at").collect()]) / fitted.n
    mean = v[width * width:]
    return float(np.abs(v[:width * width].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())


def _deviations(x: np.ndarray, fitted: Fit) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2, exact."""
    reach = fitted.n * (float(np.abs(x).max(initial=0.0)) + float(np.abs(_means(fitted.n, fitted.sums)[0]).max()) + 1)
    if reach < 1 << 62:
        v = fitted.n * x.astype(np.int64) - np.array(fitted.sums, np.int64)
        if float(np.abs(v).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return pa.array((v * v).sum(axis=1)).cast(pa.decimal128(38, 0))
    import decimal
    return pa.array([decimal.Decimal(sum((fitted.n * int(c) - s) ** 2 for c, s in zip(row, fitted.sums, strict=True))) for row in x.tolist()],
                    pa.decimal128(38, 0))


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row that the fit holds.

    Entries c become the whole numbers x = floor(1024 c) + 100000.  Rows whose vector is null, empty or holds a
    null or non-finite entry are dropped, and so are rows whose vector has another length than most (of equally
    common lengths the largest counts) or entries of 2^50 and more.  Equal rows and rows with equal or null keys
    stay rows of their own; tied eigenvalues get some orthonormal directions, the same for all rows.  Directions
    without variance have no rows, so an empty table, a single row and equal rows alone give none.  Other columns
    are not read.  ``deviation`` is a decimal, since (n x - S)^2 outgrows 64 bits with n.
    """
    own = _vectors(rows.select(F.col(vector).alias("vector"), F.col(key).alias("key")), "vector")
    fields = ["component int", "n long", "deviation decimal(38,0)", "whitened double", "explained double", "identity_error double"]
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), *T.StructType.fromDDL(", ".join(fields)).fields])
    names = [key, *(f.name if f.name != key else f"{f.name}_" for f in schema.fields[1:])]
    fitted = fit(rows, vector, components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema).toDF(*names)
    error = _identity_error(own.select("vector"), fitted)
    means, width = _means(fitted.n, fitted.sums), len(fitted.scales)

    def run(batches):
        for batch in batches:
            at, x, centred = _centred(batch, 0, means)
            y = centred @ fitted.directions / fitted.scales
            take = pa.array(np.repeat(at, width))
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(take), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * width, fitted.n, np.int64)),
                _deviations(x, fitted).take(pa.array(np.repeat(np.arange(len(at)), width))), pa.array(y.ravel()),
                pa.array(np.tile(fitted.explained, len(at))), pa.array(np.full(len(at) * width, error))], names=[f.name for f in schema.fields])

    return own.mapInArrow(run, schema).toDF(*names)
