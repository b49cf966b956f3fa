"""Operator 11, embedding whitening: a randomised range finder and Rayleigh-Ritz over all centred rows.

Entries become integers x = floor(SCALE * c) + SHIFT, so counts and sums are exact and a row is centred as
(n*x - S)/n without loss. A random orthonormal basis Q of k + OVERSAMPLE columns is multiplied by the covariance
V in one pass over the rows, Y = V Q; the same pass serves Rayleigh-Ritz (Q'Y is V within the basis) and gives
the residuals |V u - e u| of the components found, so every power pass knows how good the last basis was.
If they still fail after PASSES passes (a flat spectrum), the basis grows to the full dimension, where
Rayleigh-Ritz is the whole eigenproblem.

Each task adds up one matrix of dimension x columns; tasks' matrices are added in SLOTS groups before the driver
adds those, so what the driver holds depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS, OVERSAMPLE, PASSES = 32, 16, 4
#: Residuals and least eigenvalues count against the largest eigenvalue.
RESIDUAL, LEAST = 1e-13, 1e-12
SLOTS = 64
#: Beyond it floor(SCALE * c) + SHIFT is no long.
_LARGEST = 2.0**62


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # one column a component
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0
    passes: int = 0
    expanded: bool = False


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of whole, finite vectors, and for all rows the lengths and the entries' offsets into `entries(column)`."""
    at = column.offsets.to_numpy().astype(np.int64)
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        bad = ~(np.abs(entries * SCALE) < _LARGEST)
    faults = np.concatenate([[0], np.cumsum(bad)])
    length = np.diff(at)
    whole = (faults[at[1:]] == faults[at[:-1]]) & (length > 0)
    if column.null_count:
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(whole), length, at


def integers(column: pa.Array, rows: np.ndarray, at: np.ndarray, dim: int) -> np.ndarray:
    """The x-vectors of these rows, all of length dim."""
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    picked = entries[at[rows][:, None] + np.arange(dim)]
    return np.floor(picked * SCALE).astype(np.int64) + SHIFT


def of_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, length, at = usable(column)
    rows = rows[length[rows] == dim]
    return rows, integers(column, rows, at, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as longs where they fit, else as Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(dev: np.ndarray) -> list[Decimal | None]:
    """Sum of squares of each row; null beyond 38 digits."""
    if dev.dtype != object and int(np.abs(dev).max(initial=0)) ** 2 * max(1, dev.shape[1]) < 1 << 62:
        return [Decimal(v) for v in (dev * dev).sum(axis=1).tolist()]
    exact = [sum(int(v) * int(v) for v in row) for row in dev.tolist()]
    return [Decimal(v) if v < 10**38 else None for v in exact]


def added(rows: DataFrame, shape: tuple[int, ...], step: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum of step(batch's vectors) over all rows, each a float matrix of this shape."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += step(batch.column(0))
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(shape), False
        for batch in batches:
            for blob in batch.column(1):
                total += np.frombuffer(blob.as_buffer(), np.float64).reshape(shape)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    dealt = rows.mapInArrow(partial, "slot int, total binary").repartition(SLOTS, "slot")
    out = np.zeros(shape)
    for row in dealt.mapInArrow(merged, "total binary").collect():  # a matrix for each slot
        out += np.frombuffer(row["total"], np.float64).reshape(shape)
    return out


def counts(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, n, S): of the commonest length among usable vectors (of the larger one if tied), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            ok, length, at = usable(batch.column(0))
            for dim in np.unique(length[ok]).tolist():
                x = integers(batch.column(0), ok[length[ok] == dim], at, dim)
                seen = total.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                seen[0] += len(x)
                seen[1] += (x >> 32).sum(axis=0)
                seen[2] += (x & 0xFFFFFFFF).sum(axis=0)
        if total:
            yield pa.RecordBatch.from_pydict(
                {"dim": list(total), "n": [v[0] for v in total.values()], "high": [v[1] for v in total.values()], "low": [v[2] for v in total.values()]},
                schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]),
            )

    partial = rows.mapInArrow(run, "dim int, n long, high array<long>, low array<long>")
    partial = common.materialize(partial, "whitening-sums")
    top = partial.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not top:
        common.discard(partial)
        return 0, 0, []
    dim, n = top[0]["dim"], top[0]["n"]
    entries = partial.where(F.col("dim") == dim).select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "e"))
    sums = [0] * dim
    for r in entries.groupBy("i").agg(F.sum("e.high").alias("high"), F.sum("e.low").alias("low")).collect():  # dim rows
        sums[r["i"]] = (r["high"] << 32) + r["low"]
    common.discard(partial)
    return dim, n, sums


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 11) -> Whitening:
    """The whitening of all usable vectors of a column of arrays.

    Left out: null and empty vectors, vectors with null or non-finite entries or ones whose x is no long, and
    vectors of another length than most usable ones have. Repeated rows count each. Components whose variance is
    below LEAST of the largest are left out, since nothing can scale them to one: a constant table has none, and
    n rows have n - 1 at most. An empty table gives n = 0 and no components.
    """
    rows = table.select(F.col(column).cast("array<double>").alias("v"))
    dim, n, sums = counts(rows)
    model = Whitening(n, sums)
    if n == 0:
        return model

    def centred(batch: pa.Array) -> np.ndarray:
        return deviations(of_length(batch, dim)[1], n, sums).astype(np.float64) / n

    def times(basis: np.ndarray) -> np.ndarray:
        """V times the basis, and the rows' squares in one more line: their sum is the trace of V."""

        def step(batch: pa.Array) -> np.ndarray:
            z = centred(batch)
            return np.vstack([z.T @ (z @ basis), np.full((1, basis.shape[1]), (z * z).sum())])

        return added(rows, (dim + 1, basis.shape[1]), step) / n

    k = min(components, dim)
    width = min(dim, k + oversample)
    full = width == dim
    basis = np.eye(dim) if full else np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    while True:
        y = times(basis)
        y, trace = y[:-1], float(y[-1, 0])
        model.passes += 1
        small = basis.T @ y
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        left = np.linalg.norm(y @ w - (basis @ w) * e, axis=0)
        if full or e[0] <= 0 or left.max() <= RESIDUAL * e[0]:
            break
        if model.passes > passes:
            full = model.expanded = True
            basis = np.eye(dim)
        else:
            basis = np.linalg.qr(y)[0]
    keep = e > LEAST * e[0] if e[0] > 0 else np.zeros(k, bool)
    model.values, model.vectors = e[keep], (basis @ w)[:, keep]
    model.explained = model.values / trace if trace else model.values
    if keep.any():
        scaled = model.vectors / np.sqrt(model.values)
        m = scaled.shape[1]

        def spread(batch: pa.Array) -> np.ndarray:
            v = centred(batch) @ scaled
            return np.vstack([v.T @ v, v.sum(axis=0)])

        total = added(rows, (m + 1, m), spread) / n
        model.identity_error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(m)).max())
    return model


def whiten(table: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, deviation decimal(38,0), whitened array<double>) of every usable vector of the model's length.

    deviation is the sum over dimensions of (n*x - S)^2, null beyond 38 digits. Rows that `fit` leaves out
    have no row here; repeated and null keys keep theirs; other columns of the table are left out.
    """
    kind = table.schema[key].dataType.simpleString()
    dim, n, sums = len(model.sums), model.n, model.sums
    scaled = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((dim, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not n:
                continue
            ok, x = of_length(batch.column(1), dim)
            dev = deviations(x, n, sums)
            out = (dev.astype(np.float64) / n) @ scaled
            ends = pa.array(np.arange(len(ok) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ok)), pa.array(squares(dev), pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                names=[key, "deviation", "whitened"],
            )

    rows = table.select(F.col(key), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")
