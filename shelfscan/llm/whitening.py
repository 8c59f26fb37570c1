"""Whitening of vectors by shifted CholeskyQR over distributed Gram passes.

Vectors become whole numbers, so that sums and squared deviations are exact. The centred rows A
are never kept: every pass makes them again from the table and applies the triangular factor R
found so far, Q = A R^-1, by a triangular solve in each task. It returns the Gram matrix of Q
alone, whose Cholesky factor is composed into R. The first Gram matrix gets a shift, so that
its factor exists however ill-conditioned the rows are; further passes take Q to orthogonality.
Dimensions that depend on others up to rounding are set aside on the way.
Then A = Q R and the singular values and right vectors of the small R give the components.

Only matrices of dimension x dimension reach the driver; sums of tasks are added in slices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, LIFT = 1024, 100_000
_PASSES = 12
_ROWS = 4096
_WHOLE = 2**63


def finite(vector: str):
    """True for vectors that are not null and whose entries are all finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of every entry, as int64."""
    found = np.floor(SCALE * matrix.astype(np.float64))
    if found.size and np.abs(found).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a whole number of 64 bits")
    return found.astype(np.int64) + LIFT


def _matrices(batch, at: int, width: int):
    """Blocks of at most _ROWS vectors (whole numbers) of a batch, with their first row."""
    for first in range(0, batch.num_rows, _ROWS):
        column = batch.column(at).slice(first, _ROWS)
        values = column.flatten().to_numpy(zero_copy_only=False)
        yield first, whole_numbers(values.reshape(len(column), width))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact whole number n x - S."""
    return _distance(x, n, sums) / n


def _distance(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if x.size and n * int(np.abs(x).max()) >= _WHOLE // 2:
        return (n * x.astype(object) - sums.astype(object)).astype(np.float64)
    return (n * x - sums.astype(np.int64)).astype(np.float64)


def _solved(a: np.ndarray, factor: np.ndarray, live: np.ndarray) -> np.ndarray:
    """a factor^-1 by forward substitution; ``factor`` is upper triangular.

    Dimensions that are not ``live`` depend on those before them: their columns stay zero.
    """
    out = np.zeros_like(a)
    for j in np.flatnonzero(live):
        out[:, j] = (a[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _total(partials: DataFrame, merge) -> bytes | None:
    """One merged ``state`` of the tasks' states: (task int, state binary), in slices first.

    As many slices as the root of the number of tasks, merged in order of the tasks.
    """
    tasks = max(1, partials.rdd.getNumPartitions())
    slices = max(1, math.isqrt(tasks))

    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("task").to_pylist(), table.column("state").to_pylist()))
        state = None
        for _, other in found:
            state = other if state is None else merge(state, other)
        return pa.table(
            {"task": pa.array([found[0][0]], pa.int32()), "state": pa.array([state], pa.binary())}
        )

    kind = "task int, state binary"
    some = partials.groupBy(F.pmod("task", F.lit(slices))).applyInArrow(run, kind)
    found = some.groupBy().applyInArrow(run, kind).collect()
    return bytes(found[0]["state"]) if found else None


def _states(rows: DataFrame, start, add) -> DataFrame:
    """(task, state): ``add(state, batch)`` over all batches of a task that has rows."""

    def run(batches):
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(start() if state is None else state, batch)
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int32()),
                    pa.array([np.ascontiguousarray(state).tobytes()], pa.binary()),
                ],
                names=["task", "state"],
            )

    return rows.mapInArrow(run, "task int, state binary")


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


@dataclass
class Whitening:
    """A fitted model: sums and number of rows, the factor R, components by falling variance."""

    n: int
    sums: np.ndarray
    factor: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    passes: int

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scale(self, components: int) -> np.ndarray:
        """Matrix from centred rows to whitened ones; constant directions have no component."""
        e = self.variances
        some = e > (e[0] if len(e) else 0) * max(self.dimension, 1) * np.finfo(float).eps
        k = min(components, int(some.sum()))
        return self.vectors[:, :k] / np.sqrt(e[:k])


def _sums(rows: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension, counted by Spark in whole numbers."""
    value = F.floor(F.lit(float(SCALE)) * F.col("v").cast("double")).cast("decimal(38,0)")
    found = (
        rows.select(F.posexplode(vector).alias("i", "v"))
        .groupBy("i")
        .agg(F.count("*").alias("n"), F.sum(value + F.lit(LIFT)).alias("s"))
        .orderBy("i")
        .collect()
    )
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of different lengths cannot be whitened together")
    return (found[0]["n"] if found else 0), np.array([int(r["s"]) for r in found], dtype=object)


def fit(rows: DataFrame, vector: str = "embedding") -> Whitening:
    """Fit on all rows whose vector is not null and has finite entries only.

    Vectors of different lengths are an error. Empty tables and empty vectors give a model
    without components. Rows may repeat; each counts. Memory on the driver and in a task is a
    few matrices of dimension x dimension.
    """
    rows = rows.select(vector).filter(finite(vector) & (F.size(vector) > 0))
    n, sums = _sums(rows, vector)
    d = len(sums)
    if not n:
        none = np.zeros((0, 0))
        return Whitening(0, sums, none, np.zeros(0), none, 0)
    factor, live = np.eye(d), np.ones(d, dtype=bool)
    least = 16 * d * np.finfo(float).eps
    for done in range(1, _PASSES + 1):

        def add(state, batch, factor=factor, live=live):
            for _, x in _matrices(batch, 0, d):
                q = _solved(_centred(x, n, sums), factor, live)
                state += q.T @ q
            return state

        found = _total(_states(rows, lambda: np.zeros((d, d)), add), _added)
        gram = np.frombuffer(found).reshape(d, d)
        # What a dimension has beyond those before it; mere rounding means it depends on them.
        beyond = np.abs(np.diag(factor)) * np.sqrt(np.diag(gram)) * live
        some = beyond > least * beyond.max()
        if (some != live).any():
            live, factor = some, factor * some[:, None]
            if done > 1 and live.any():
                continue
        if not live.any():
            break
        part = gram[np.ix_(live, live)]
        near = np.abs(part - np.eye(len(part))).max() < 1e-10
        u = np.finfo(float).eps / 2
        shift = 11 * (n * d + d * (d + 1)) * u * np.trace(part) if done == 1 else 0.0
        try:
            step = np.linalg.cholesky(part + min(shift, np.trace(part)) * np.eye(len(part))).T
        except np.linalg.LinAlgError:
            shift = min(11 * (n * d + d * (d + 1)) * u, 1.0) * np.trace(part)
            step = np.linalg.cholesky(part + shift * np.eye(len(part))).T
        factor = factor.copy()
        factor[live] = step @ factor[live]
        if done > 1 and near:
            break
    _, s, vt = np.linalg.svd(factor)
    return Whitening(n, sums, factor, s**2 / n, vt.T, done)


def _joined(a: bytes, b: bytes) -> bytes:
    """Number, mean and centred products of two lists of rows from those of each."""
    a, b = np.frombuffer(a), np.frombuffer(b)
    k = int((math.isqrt(4 * len(a) - 3) - 1) // 2)
    n, m = a[0] + b[0], b[0]
    apart = b[1 : k + 1] - a[1 : k + 1]
    mean = a[1 : k + 1] + apart * (m / n)
    products = a[k + 1 :] + b[k + 1 :] + (np.outer(apart, apart) * (a[0] * m / n)).ravel()
    return np.concatenate([[n], mean, products]).tobytes()


def identity_error(
    rows: DataFrame, model: Whitening, vector: str = "embedding", components: int = 8
) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity; None without any."""
    rows = rows.select(vector).filter(finite(vector) & (F.size(vector) > 0))
    n, sums, d, scale = model.n, model.sums, model.dimension, model.scale(components)
    k = scale.shape[1] if n else 0
    if not k:
        return None

    def add(state, batch):
        for _, x in _matrices(batch, 0, d):
            w = _centred(x, n, sums) @ scale
            mean = w.mean(axis=0)
            products = (w - mean).T @ (w - mean)
            part = np.concatenate([[len(w)], mean, products.ravel()])
            if state is not None:
                part = np.frombuffer(_joined(state.tobytes(), part.tobytes()))
            state = part
        return state

    found = np.frombuffer(_total(_states(rows, lambda: None, add), _joined))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(
    rows: DataFrame, model: Whitening, vector: str = "embedding", components: int = 8
) -> DataFrame:
    """Columns of ``rows`` with ``deviation`` (long) and ``whitened`` (array of doubles).

    ``deviation`` is the exact sum over dimensions of (n x - S)^2; where it does not fit a long
    the query fails rather than rounds. Rows whose vector is null or holds null or non-finite
    entries are left out, as in ``fit``; rows with empty vectors or where nothing varies get
    an empty array. Input columns deviation and whitened are replaced.
    """
    made = ("deviation", "whitened")
    kept = [c for c in rows.columns if c.lower() not in made]
    n, sums, d, scale = model.n, model.sums, model.dimension, model.scale(components)
    position = kept.index(vector)

    def deviations(x):
        if n * int(np.abs(x).max(initial=0)) < _WHOLE // 2:
            far = n * x - sums.astype(np.int64)
            if float((far.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < _WHOLE / 2:
                return (far**2).sum(axis=1)
        far = n * x.astype(object) - sums
        found = (far**2).sum(axis=1)
        if len(found) and max(found) >= _WHOLE:
            raise OverflowError("a deviation does not fit a long")
        return found.astype(np.int64)

    def run(batches):
        for batch in batches:
            deviation, whitened = [], []
            for first in range(0, batch.num_rows, _ROWS):
                column = batch.column(position).slice(first, _ROWS)
                width = len(column.flatten()) // len(column)
                if not width:
                    deviation.append(np.zeros(len(column), np.int64))
                    whitened.append(np.zeros((len(column), 0)))
                    continue
                values = column.flatten().to_numpy(zero_copy_only=False)
                x = whole_numbers(values.reshape(len(column), d))
                deviation.append(deviations(x))
                whitened.append(_centred(x, n, sums) @ scale)
            if not batch.num_rows:
                continue
            lists = [pa.array(list(w), pa.list_(pa.float64())) for w in whitened]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(deviation)), pa.concat_arrays(lists)],
                names=[*kept, *made],
            )

    good = rows.select(*kept).filter(finite(vector))
    schema = T.StructType(
        [
            *rows.select(*kept).schema.fields,
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    return good.mapInArrow(run, schema)
