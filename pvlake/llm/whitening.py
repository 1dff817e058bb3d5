"""Operator 13, embedding whitening by shifted CholeskyQR.

Every vector lies on a grid: an entry c is x = floor(1024 c) + 100000. With n vectors and sums S, the
centred row is x - S / n, taken as (x - m) - r / n with S = m n + r in whole numbers, so the offset
cancels exactly before any rounding. Each pass sums the Gram matrix of the rows held so far, adds a
shift to the first one (later ones only if they are not positive definite), factors it by Cholesky
and puts the rows through the triangular solve. The rows stay where they are: a pass sends only
its factor to the tasks, which solve by all factors one after another. The factors are composed to one R with
A = Q R, and the singular values and right vectors of R are those of the centred table. The passes end
when Q is orthonormal to rounding, five at most; repeating the shift makes directions
without variance vanish from R instead of failing.

What reaches the driver is one d x d matrix a pass. Matrices of tasks are summed in rounds of ``FAN``
to one, so no task and not the driver holds more than a stream of them.

Defined results: rows whose vector is null, or holds a null, a non-finite entry or one of 2 ** 40 or more, are dropped;
of the others the most frequent length counts (of equally frequent ones the longest), rows of
other lengths and empty ones are dropped too. Directions without variance (singular value
below 1e-10 of the largest) give no component. Rows that repeat count as often as they occur, and
vec_id is carried, null or not. An empty table gives no rows. A deviation beyond 64 bits is null.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import on_workers

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Entries of this size and more are off the grid.
LARGEST = float(1 << 40)
PASSES = 5
TOLERANCE = 1e-13
#: Singular values below this share of the largest are rounding.
RANK = 1e-10
#: Matrices that one task adds up.
FAN = 64
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _valid(entries) -> F.Column:
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return entries.isNotNull() & ~bad


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of every remaining row: grid vectors of one length."""
    on_workers(embeddings.sparkSession)
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("c"))
    rows = rows.where(_valid(F.col("c")) & (F.size("c") > 0))
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("c") == d).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(1)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _added(rows: DataFrame, per_batch: Callable[[np.ndarray], np.ndarray], merge=np.add) -> np.ndarray | None:
    """The merged arrays of all batches: one a task, then in rounds of ``FAN`` to one."""
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = per_batch(_matrix(b))
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": [int(total.shape[0])], "a": [total.tobytes()]})

    kind = np.int64 if per_batch is _digit_sums else np.float64

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k, a in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(a.as_buffer(), kind).reshape(k, -1)
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": [int(total.shape[0])], "a": [total.tobytes()]})

    parts = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(task, "k long, a binary")
    while parts > 1:
        parts = -(-parts // FAN)
        out = out.repartition(parts).mapInArrow(join, "k long, a binary")
    got = out.collect()
    return np.frombuffer(bytes(got[0]["a"]), kind).reshape(got[0]["k"], -1) if got else None


def _digit_sums(x: np.ndarray) -> np.ndarray:
    """Row count and sums of two digits of base 2 ** 20, so that 2 ** 31 rows of any valid entries fit."""
    return np.stack([np.full(x.shape[1], len(x), np.int64), (x >> 20).sum(0), (x & 0xFFFFF).sum(0)])


def _centred(x: np.ndarray, m: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    return (x - m).astype(np.float64) - r / n


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q with Q R = rows, R upper triangular: forward substitution over columns, in blocks of 64."""
    q = np.array(rows)
    d = len(factor)
    for start in range(0, d, 64):
        stop = min(d, start + 64)
        q[:, start:stop] -= q[:, :start] @ factor[:start, start:stop]
        for j in range(start, stop):
            q[:, j] -= q[:, start:j] @ factor[start:j, j]
            q[:, j] /= factor[j, j]
    return q


def _cholesky(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """R with R'R = gram, shifted for the first pass and wherever gram isn't positive definite."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.trace(gram), np.finfo(float).tiny)
    shift = min(shift, 1e-6 * max(np.trace(gram), np.finfo(float).tiny))
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            shift = 1e-14 * max(np.trace(gram), 1.0)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 100


def _moments(w: np.ndarray) -> np.ndarray:
    """Row count, mean and centred products, each a row of the array."""
    mean = w.mean(0)
    return np.vstack([np.full(w.shape[1], float(len(w))), mean, (w - mean).T @ (w - mean)])


def _merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb, delta = a[0, 0], b[0, 0], b[1] - a[1]
    out = a + b
    out[1] = a[1] + delta * (nb / (na + nb))
    out[2:] += np.outer(delta, delta) * (na * nb / (na + nb))
    return out


class Whitening:
    """Fitted components; ``variances`` fall, ``weights`` are columns v / sqrt(e)."""

    def __init__(self, n: int, m: np.ndarray, r: np.ndarray, trace: float, variances: np.ndarray, axes: np.ndarray, passes: int):
        self.n, self.m, self.r, self.trace, self.passes = n, m, r, trace, passes
        self.variances, self.axes = variances, axes
        self.weights = axes / np.sqrt(variances)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of ``vectors()`` rows; None without rows or variance."""
    sums = _added(rows, _digit_sums)
    if sums is None:
        return None
    n, d = int(sums[0, 0]), sums.shape[1]
    total = [(int(h) << 20) + int(lo) for h, lo in zip(sums[1], sums[2], strict=True)]
    m = np.array([s // n for s in total], np.int64)
    r = np.array([s % n for s in total], np.float64)
    factors: list[np.ndarray] = []
    composed, trace = np.eye(d), 0.0
    for k in range(PASSES):
        def gram(x, factors=tuple(factors)):
            q = _centred(x, m, r, n)
            for f in factors:
                q = solve(q, f)
            return q.T @ q
        g = _added(rows, gram)
        if k == 0:
            trace = float(np.trace(g)) / n
            if trace <= 0:
                return None
        elif np.abs(g - np.eye(d)).max() <= TOLERANCE * d:
            break
        factors.append(_cholesky(g, n, k == 0))
        composed = factors[-1] @ composed
    _, s, vt = np.linalg.svd(composed)
    keep = min(components, int((s > RANK * s[0]).sum()))
    return Whitening(n, m, r, trace, s[:keep] ** 2 / n, vt[:keep].T, len(factors))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    weights, m, r, n = model.weights, model.m, model.r, model.n
    got = _added(rows, lambda x: _moments(_centred(x, m, r, n) @ weights), _merge_moments)
    return float(np.abs(got[2:] / n - np.eye(weights.shape[1])).max())


def _deviation(x: np.ndarray, model: Whitening) -> list:
    """Exact sum of (n x - S) ** 2 of each row; null beyond 64 bits."""
    off = x - model.m
    rest = model.r.astype(np.int64)
    top = float(np.abs(off).max()) * model.n + float(rest.max())
    if top * top * x.shape[1] < 2.0 ** 62:
        return ((off * model.n - rest) ** 2).sum(1).tolist()
    out = [sum((a * model.n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component."""
    rows = vectors(embeddings)
    model = fit(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    error = identity_error(rows, model)
    explained = model.variances / model.trace
    k = len(explained)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            w = _centred(x, model.m, model.r, model.n) @ model.weights
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(_deviation(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)), deviation,
                pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))], schema=schema)

    return rows.mapInArrow(task, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(on_workers(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
