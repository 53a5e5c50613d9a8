"""Whitening of embeddings: Welford's rank-one updates, merged over partitions, and a symmetric QR eigen-solve.

Entries become whole numbers, so that sums and deviations are exact. Mean and scatter are fitted on each distinct vector
once: every partition updates its own by one vector at a time, and partial states merge by the parallel formula in a tree of
``FAN`` states a node. The scatter's eigenvectors come from a reduction to tridiagonal form and implicit QR steps, on the
driver: a matrix of the vectors' dimension, whatever the number of rows.

Left out: rows whose vector is null, empty, or holds null or non-finite entries, and rows whose vector has not the most
frequent length (of equally frequent ones the greatest). A null vec_id stays null, rows that repeat an id or a vector each
have their own result rows, further columns are ignored, and an empty table gives no rows. Components without variance
(fewer distinct vectors than dimensions) have whitened and explained 0 and count for nothing in identity_error. deviation
is null where it doesn't fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FAN = 16
NO_VARIANCE = 1e-13  # of the greatest eigenvalue
STATE = "part long, n long, mean binary, scatter binary, sums binary"


def whole(embeddings: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x (array<long>): floor(scale * entry) + shift of the rows that remain."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = e.filter(F.col("e").isNotNull()).filter((F.size("e") > 0) & ~bad)
    return good.select("vec_id", F.transform("e", lambda c: F.floor(c * scale) + shift).alias("x"))


class State:
    """Number, mean, scatter (sum of outer products of deviations) and exact sums of vectors."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim, np.int64)
        self._step = np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        np.multiply.outer(delta, x - self.mean, out=self._step)
        self.scatter += self._step

    def merge(self, other: State) -> State:
        """The state of both parts together."""
        n = self.n + other.n
        if other.n:
            delta = other.mean - self.mean
            self.scatter += other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
            self.mean += delta * (other.n / n)
            self.n, self.sums = n, self.sums + other.sums
        return self

    def batch(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "n": [self.n], "mean": [self.mean.tobytes()], "scatter": [self.scatter.tobytes()], "sums": [self.sums.tobytes()]}, pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("sums", pa.binary())]))


def _state(n: int, mean: bytes, scatter: bytes, sums: bytes) -> State:
    out = State(len(mean) // 8)
    out.n, out.mean, out.sums = n, np.frombuffer(mean).copy(), np.frombuffer(sums, np.int64).copy()
    out.scatter = np.frombuffer(scatter).reshape(len(out.mean), -1).copy()
    return out


def _merged(states: Iterable[tuple], dim: int) -> State:
    out = State(dim)
    for s in states:
        out.merge(_state(*s))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(x: DataFrame, dim: int, project=None, shift: int = 1_000_000) -> State:
    """The state of all rows of x(x array<long>), means less ``shift``, or of their projections by ``project`` (rows of a
    matrix to rows). Without the shift, small values keep all their digits."""
    out_dim = len(project(np.zeros((1, dim)))[0]) if project else dim

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = State(out_dim)
        for b in batches:
            rows = matrix(b.column(0), dim)
            if not project:
                state.sums += rows.sum(axis=0)
            for v in project(rows) if project else (rows - shift).astype(float):
                state.add(v)
        if state.n:
            yield state.batch(TaskContext.get().partitionId())

    states = x.select("x").mapInArrow(partial, STATE)
    parts = max(1, x.rdd.getNumPartitions())
    while parts > FAN:  # a level of the tree: partial states by number, FAN to one
        parts = -(-parts // FAN)

        def level(key, table):
            rows = table.to_pydict()
            merged = _merged(zip(rows["n"], rows["mean"], rows["scatter"], rows["sums"], strict=True), out_dim)
            return pa.Table.from_batches([merged.batch(key[0].as_py())])

        states = states.withColumn("part", F.col("part") % parts).groupBy("part").applyInArrow(level, STATE)
    return _merged(((r["n"], bytes(r["mean"]), bytes(r["scatter"]), bytes(r["sums"])) for r in states.collect()), out_dim)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix.

    Householder reflections to tridiagonal form, then implicit QR steps with Wilkinson's shift on its unreduced blocks.
    """
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = a.diagonal().copy(), a.diagonal(1).copy()
    eps, hi = np.finfo(float).eps, n - 1
    for _ in range(60 * max(1, n)):
        small = np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0.0
        while hi > 0 and e[hi - 1] == 0:
            hi -= 1
        if hi == 0:
            break
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half if half else 1.0))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chase the bulge down by rotations
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, w = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p - 2 * c * s * w + s * s * t, s * s * p + 2 * c * s * w + c * c * t
            e[k] = c * s * (p - t) + (c * c - s * s) * w
            if k < hi - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            q[:, [k, k + 1]] = np.stack([c * q[:, k] - s * q[:, k + 1], s * q[:, k] + c * q[:, k + 1]], axis=1)
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def components(state: State, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) of the covariance, the first ``most``."""
    cov = (state.scatter + state.scatter.T) / (2 * max(1, state.n))
    values, vectors = symmetric_qr(cov)
    values = np.where(values > NO_VARIANCE * max(values.max(initial=0.0), 0.0), values, 0.0)
    return values[:most], vectors[:, :most], float(np.trace(cov))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, exact; None where it is no long."""
    if not len(x):
        return []
    most = float(np.abs(x.astype(float) * n - sums).max())
    if most * most * x.shape[1] < 2.0**62 and n * float(np.abs(x).max()) < 2.0**62:
        d = n * x - sums
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = 16) -> DataFrame:
    """RESULT rows of each remaining row of embeddings(vec_id, embedding) and component, from the greatest eigenvalue on."""
    x = whole(embeddings)
    lengths = x.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    dim = lengths[0]["dim"]
    x = x.filter(F.size("x") == dim)
    distinct = written(x.select("x").distinct(), "vectors")  # read twice
    state = fit(distinct, dim)
    values, vectors, trace = components(state, most)
    n, sums, k = state.n, state.sums, len(values)
    scale = np.divide(1.0, np.sqrt(values), out=np.zeros(k), where=values > 0)
    weights, top, rest = vectors * scale, sums // n, (sums % n) / n  # S / n as a whole part and a rest
    share = values / trace if trace > 0 else np.zeros(k)

    def project(rows: np.ndarray) -> np.ndarray:
        return ((rows - top) - rest) @ weights

    if (values > 0).any():
        got = fit(distinct, dim, project)
        error = got.scatter / got.n - np.diag((values > 0).astype(float))
        identity = float(np.abs(error).max())
    else:
        identity = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 2048):
                b = whole_batch.slice(a, 2048)
                rows = matrix(b.column(1), dim)
                m = len(rows)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                dev = pa.array(deviations(rows, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), dev, pa.array(project(rows).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, identity))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, RESULT)
