"""Embedding whitening: principal components by FEAST contour integration.

Two passes over the vectors give the exact integer sums and then the
covariance of the centred vectors, summed by task and merged by Spark; only
sums of the size of the dimension and of its square reach the driver.  There
the eigenpairs come from ``spectrum`` (contour integration, Rayleigh-Ritz,
inertia counts).  A third pass projects every vector, and the covariance of
what it wrote is measured in the same way.

Defined cases: null vectors and vectors with null or non-finite entries take
no part, nor do vectors of another length than the commonest (of equally
common ones the longest); scaled entries beyond +-2^56 count as that;
components without variance (eigenvalue at rounding level, as with fewer
vectors than dimensions) are left out, so equal vectors alone give no rows; a
deviation that no long can hold is null; a null vec_id stays null; repeated
rows count and are returned each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm import spectrum
from tracelab.llm.common import stash

# Fixed values of the contract: x = floor(SCALE * c) + OFFSET; components returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BOUND = 1 << 56
HALF = 28  # sums are kept in two parts of this many bits and more
LONG = (1 << 63) - 1
SLICE_ENTRIES = 1 << 21  # entries of a matrix worked on at once

Reader = Callable[[pa.RecordBatch], np.ndarray]


def commonest_length(rows: DataFrame) -> int:
    """The commonest length of the vectors that take part, 0 without any."""
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    per = rows.where(fits & (F.size("v") > 0)).groupBy(F.size("v").alias("d")).count()
    first = per.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose array has ``d`` finite entries, and these as a matrix."""
    v = batch.column(batch.schema.get_field_index(column))
    rows = np.flatnonzero(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
    m = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    good = np.isfinite(m).all(1)
    return rows[good], m[good]


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE_ENTRIES // max(1, d))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def whole(c: np.ndarray) -> np.ndarray:
    """The long entries of a matrix of components."""
    return np.clip(np.floor(SCALE * c), -BOUND, BOUND).astype(np.int64) + OFFSET


def column_sums(rows: DataFrame, read: Reader, d: int, kind: str) -> tuple[int, np.ndarray]:
    """Rows read and the sum of each column of the matrices that ``read`` gives."""
    dtype = {"long": np.int64, "double": np.float64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in _slices(batches, d):
            m = read(b)
            n, sums = n + len(m), m.sum(0, dtype=dtype) if sums is None else sums + m.sum(0, dtype=dtype)
        if n:
            at = np.arange(-1, len(sums), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[0], sums]).astype(dtype)), pa.array(np.where(at < 0, n, 0))], names=["i", "s", "n"])

    got = rows.mapInArrow(run, f"i int, s {kind}, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    by = {r.i: r for r in got}
    return (by[-1].n if by else 0), np.array([by[i].s for i in range(len(by) - 1)], dtype)


def covariance(rows: DataFrame, read: Reader, d: int, n: int) -> np.ndarray:
    """The covariance, divisor n, of the centred rows that ``read`` gives: products
    are summed by task, then by entry of the upper triangle."""
    at_i, at_j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for b in _slices(batches, d):
            m = read(b)
            total, seen = total + m.T @ m, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(at_i.astype(np.int32)), pa.array(at_j.astype(np.int32)), pa.array(total[at_i, at_j])], names=["i", "j", "s"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


@dataclass
class Whitening:
    """Sums S over n vectors and the components of their covariance, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y = x - floor(S / n), and S - n floor(S / n)."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        return x - base, np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.steps(x)
        return y - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2 of each row."""
        y, rest = self.steps(x)
        if len(y) and (int(np.abs(y).max()) + 1) * self.n <= isqrt(LONG // len(self.sums)):
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in y.tolist())
        return [e if e <= LONG else None for e in exact]


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (v) of length ``d``; None without rows."""
    mask = (1 << HALF) - 1

    def halves(b: pa.RecordBatch) -> np.ndarray:
        x = whole(_matrix(b, "v", d)[1])
        return np.concatenate([x >> HALF, x & mask], axis=1)

    n, parts = column_sums(rows, halves, d, "long")
    if not n:
        return None
    sums = [(int(hi) << HALF) + int(lo) for hi, lo in zip(parts[:d], parts[d:], strict=True)]
    start = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    cov = covariance(rows, lambda b: start.centred(whole(_matrix(b, "v", d)[1])), d, n)
    floor = d * spectrum.ROUNDING * float(np.abs(cov).sum(1).max())
    values, vectors = spectrum.largest(cov, components, floor)
    return Whitening(n, sums, values, vectors, float(np.trace(cov)))


def project(rows: DataFrame, d: int, w: Whitening) -> DataFrame:
    """``rows`` (vec_id, v) -> (vec_id, deviation, w array) of those that take part."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, d):
            at, c = _matrix(b, "v", d)
            x = whole(c)
            out = shared.value.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(shared.value.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity."""
    read = lambda b: _matrix(b, "w", k)[1]
    mean = column_sums(projected.select("w"), read, k, "double")[1] / n
    return float(np.abs(covariance(projected.select("w"), lambda b: read(b) - mean, k, n) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) by
    vector that takes part and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    d = commonest_length(rows)
    w = fit(rows.select("v"), d, components) if d else None
    k = len(w.values) if w else 0
    if not k:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    projected = stash(project(rows, d, w), "whitened")
    error = identity_error(projected, w.n, k)
    shares = F.array(*[F.lit(float(e / w.trace)) for e in w.values])
    each = projected.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("w").alias("w"), shares.alias("share"))).alias("pos", "z"))
    return each.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        F.col("z.w").alias("whitened"), F.col("z.share").alias("explained"), F.lit(error).alias("identity_error"),
    )
