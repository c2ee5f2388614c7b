"""Top-K sparse autoencoder as Spark jobs.

The data is a DataFrame with one vector per row; the model is either a small
set of dense parameters (``SaeParams``), shipped as a size-checked broadcast,
or a table of latents (``StoredModel``).  Either way encoding, top-k selection
and decoding run in one Arrow-batched ``mapInArrow`` pass over the rows, read
once and without a shuffle.  The files of a stored model go to the executors
by ``addFile``; a task streams them block by block past its rows and keeps the
running top k of each row, so neither the driver nor a task ever holds the
model.

Feature output is *sparse long*: exactly ``k`` rows per input row
``(id, latent_id, rank, value)``; zero-valued entries are kept when fewer
than ``k`` latents are positive (they are part of the top-k set).
"""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.session import DEFAULT_BROADCAST_BUDGET, ensure_checkpoint_dir

# Rows of one encode chunk are capped so that the dense (rows x d_sae)
# pre-activation matrix stays near this many bytes inside a Python worker.
CHUNK_BYTES = 32 * 1024 * 1024
# A stored model streams past the rows in blocks of this many bytes of weights,
# once for every so many bytes of rows.
BLOCK_BYTES = 16 * 1024 * 1024
ROWS_BYTES = 64 * 1024 * 1024


@dataclass
class SaeParams:
    """Dense parameters of a Top-K SAE (driver side, float64)."""

    w_enc: np.ndarray  # [d_model, d_sae]
    b_enc: np.ndarray  # [d_sae]
    w_dec: np.ndarray  # [d_sae, d_model]
    b_dec: np.ndarray  # [d_model]
    k: int
    activation_count: np.ndarray = field(default=None)  # [d_sae] int64
    steps_since: np.ndarray = field(default=None)  # [d_sae] int64
    step: int = 0
    best_l2_ratio: float = float("inf")

    def __post_init__(self):
        if self.activation_count is None:
            self.activation_count = np.zeros(self.d_sae, dtype=np.int64)
        if self.steps_since is None:
            self.steps_since = np.zeros(self.d_sae, dtype=np.int64)

    @property
    def d_model(self) -> int:
        return int(self.w_enc.shape[0])

    @property
    def d_sae(self) -> int:
        return int(self.w_enc.shape[1])

    @property
    def nbytes(self) -> int:
        return int(self.w_enc.nbytes + self.w_dec.nbytes + self.b_enc.nbytes + self.b_dec.nbytes)

    def copy(self) -> "SaeParams":
        return replace(
            self,
            w_enc=self.w_enc.copy(),
            b_enc=self.b_enc.copy(),
            w_dec=self.w_dec.copy(),
            b_dec=self.b_dec.copy(),
            activation_count=self.activation_count.copy(),
            steps_since=self.steps_since.copy(),
        )


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows divided by max(norm, 1e-12) (X7 on the driver-side matrices)."""
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.maximum(norms, 1e-12)


def fixture_params(d_model: int = 64, d_sae: int = 256, k: int = 8, sparse: bool = False) -> SaeParams:
    """Deterministic test model, every constant exact in binary.

    Fixed values (the shared test fixture):
      w_enc[i][j] = ((i*31 + j*17 + i*j*7) % 257 - 128) / 256   (latent i, dimension j)
      b_enc[i]    = ((i*13) % 11 - 5) / 64, or -0.6 for the sparse variant
      b_dec       = 0
      w_dec[i]    = unit_norm(w_enc[i])
    """
    i = np.arange(d_sae, dtype=np.int64)[:, None]
    j = np.arange(d_model, dtype=np.int64)[None, :]
    rows = ((i * 31 + j * 17 + i * j * 7) % 257 - 128) / 256.0  # [d_sae, d_model]
    if sparse:
        b_enc = np.full(d_sae, -0.6)
    else:
        b_enc = ((np.arange(d_sae) * 13) % 11 - 5) / 64.0
    return SaeParams(
        w_enc=np.ascontiguousarray(rows.T),
        b_enc=b_enc.astype(np.float64),
        w_dec=unit_rows(rows),
        b_dec=np.zeros(d_model),
        k=k,
    )


# --------------------------------------------------------------------------
# numpy kernels (run inside Python workers on Arrow batches)
# --------------------------------------------------------------------------


def topk_select(zr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k largest entries per row, ties broken by the lower latent id.

    Returns (ids, values), both [n, k], ordered by (value desc, id asc).
    """
    n, m = zr.shape
    k = min(k, m)
    if n == 0 or k == 0:
        return np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
    thr = -np.partition(-zr, k - 1, axis=1)[:, k - 1]
    gt = zr > thr[:, None]
    need = k - gt.sum(axis=1)
    eq = zr == thr[:, None]
    sel = gt | (eq & (np.cumsum(eq, axis=1) <= need[:, None]))
    cols = np.nonzero(sel)[1].reshape(n, k)
    vals = np.take_along_axis(zr, cols, axis=1)
    order = np.lexsort((cols, -vals), axis=-1)
    return np.take_along_axis(cols, order, axis=1).astype(np.int64), np.take_along_axis(vals, order, axis=1)


def encode_dense(x: np.ndarray, w_enc, b_enc, b_dec) -> np.ndarray:
    return (x - b_dec) @ w_enc + b_enc


def list_matrix(col: pa.Array, width: int | None = None) -> np.ndarray:
    """Arrow list<float|double> column -> dense float64 [n, d] matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, width or 0))
    if col.null_count:
        raise ValueError("null vector in input")
    offsets = col.offsets.to_numpy()
    lens = np.diff(offsets)
    d = int(lens[0])
    if (lens != d).any() or (width is not None and d != width):
        raise ValueError(f"vectors must all have length {width or d}")
    values = col.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, d)


def matrix_list(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), type=pa.float64()))


def _chunk_rows(d_sae: int) -> int:
    return max(1, CHUNK_BYTES // (8 * max(d_sae, 1)))


# --------------------------------------------------------------------------
# Models as tables
# --------------------------------------------------------------------------

LATENTS = T.StructType(
    [
        T.StructField("latent_id", T.LongType(), False),
        T.StructField("w_enc", T.ArrayType(T.DoubleType(), False)),
        T.StructField("b_enc", T.DoubleType(), False),
        T.StructField("w_dec", T.ArrayType(T.DoubleType(), False)),
        T.StructField("activation_count", T.LongType(), False),
        T.StructField("steps_since", T.LongType(), False),
    ]
)


def latents_frame(spark: SparkSession, params: SaeParams, lo: int = 0, hi: int | None = None) -> DataFrame:
    """R6 latent table: one row per latent (``lo`` to ``hi``) with its encoder
    column and decoder row; handed over as Arrow columns."""
    hi = params.d_sae if hi is None else hi
    table = pa.table(
        {
            "latent_id": pa.array(np.arange(lo, hi)),
            "w_enc": matrix_list(np.ascontiguousarray(params.w_enc.T[lo:hi], dtype=np.float64)),
            "b_enc": pa.array(params.b_enc[lo:hi].astype(np.float64)),
            "w_dec": matrix_list(np.ascontiguousarray(params.w_dec[lo:hi], dtype=np.float64)),
            "activation_count": pa.array(params.activation_count[lo:hi].astype(np.int64)),
            "steps_since": pa.array(params.steps_since[lo:hi].astype(np.int64)),
        }
    )
    return spark.createDataFrame(table, schema=LATENTS)


def latent_ranges(n: int, row_bytes: int, budget: int = DEFAULT_BROADCAST_BUDGET) -> Iterator[tuple[int, int]]:
    """Ranges of latents 0 to n - 1 of at most ``budget`` bytes each."""
    step = max(1, budget // row_bytes)
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def write_latents(spark: SparkSession, params: SaeParams, path: str, mode: str = "overwrite", budget: int = DEFAULT_BROADCAST_BUDGET) -> None:
    """The latent table as Parquet, at most ``budget`` bytes a job."""
    for lo, hi in latent_ranges(params.d_sae, (2 * params.d_model + 3) * 8, budget):
        part = latents_frame(spark, params, lo, hi)
        part.write.mode(mode if lo == 0 else "append").option("parquet.block.size", BLOCK_BYTES).parquet(path)


@dataclass(frozen=True)
class StoredModel:
    """A model whose latents (w_enc, b_enc, w_dec by latent_id) lie in Parquet
    files; known to the tasks by the files' names."""

    files: tuple[str, ...]
    d_model: int
    d_sae: int
    k: int
    b_dec: np.ndarray

    @classmethod
    def of(cls, latents: DataFrame, b_dec, k: int) -> StoredModel:
        """From a DataFrame that reads Parquet files; these are shipped to the executors."""
        sc = latents.sparkSession.sparkContext
        files = sorted(latents.inputFiles())
        for f in files:
            sc.addFile(f)
        b_dec = np.asarray(b_dec, dtype=np.float64)
        return cls(tuple(posixpath.basename(f) for f in files), len(b_dec), latents.count(), k, b_dec)

    @property
    def block_rows(self) -> int:
        return max(1, BLOCK_BYTES // (8 * self.d_model))

    def blocks(self, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids, column, ...) block by block, by rising id in a block (in a task)."""
        for name in self.files:
            with pq.ParquetFile(SparkFiles.get(name)) as f:
                for b in f.iter_batches(batch_size=self.block_rows, columns=["latent_id", *columns]):
                    ids = b.column("latent_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    parts = [list_matrix(c, self.d_model) if pa.types.is_list(c.type) else c.to_numpy() for c in (b.column(x) for x in columns)]
                    yield ids[order], *(p[order] for p in parts)

    def top_k(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``topk_select`` of the whole encoding: the running top k of each row
        merged with that of every block."""
        n = len(x)
        ids, vals = np.zeros((n, 0), np.int64), np.zeros((n, 0))
        for at, w, b in self.blocks("w_enc", "b_enc"):
            step = _chunk_rows(len(at))
            found = [topk_select(np.maximum((x[s : s + step] - self.b_dec) @ w.T + b, 0.0), self.k) for s in range(0, n, step)]
            ids = np.concatenate([ids, at[np.concatenate([f[0] for f in found])]], axis=1)
            vals = np.concatenate([vals, np.concatenate([f[1] for f in found])], axis=1)
            best = np.lexsort((ids, -vals), axis=-1)[:, : self.k]
            ids, vals = np.take_along_axis(ids, best, axis=1), np.take_along_axis(vals, best, axis=1)
        return ids, vals

    def decode(self, ids: np.ndarray, vals: np.ndarray) -> np.ndarray:
        out = np.tile(self.b_dec, (len(ids), 1))
        for at, w in self.blocks("w_dec"):
            place = np.minimum(np.searchsorted(at, ids), len(at) - 1)
            hit = at[place] == ids
            for j in range(ids.shape[1]):
                rows = np.flatnonzero(hit[:, j] & (vals[:, j] != 0))
                out[rows] += vals[rows, j, None] * w[place[rows, j]]
        return out

    def decode_unused(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """What the latents that are not ``active`` give together, without the bias."""
        out = np.zeros_like(x)
        for at, w, b, d in self.blocks("w_enc", "b_enc", "w_dec"):
            dead = ~np.isin(at, active)
            out += np.maximum((x - self.b_dec) @ w[dead].T + b[dead], 0.0) @ d[dead]
        return out


def store_params(spark: SparkSession, params: SaeParams) -> StoredModel:
    """A model in memory as a table in the shared folder."""
    path = posixpath.join(ensure_checkpoint_dir(spark), f"latents-{uuid.uuid4().hex}")
    write_latents(spark, params, path)
    return StoredModel.of(spark.read.schema(LATENTS).parquet(path), params.b_dec, params.k)


# --------------------------------------------------------------------------
# Spark operators
# --------------------------------------------------------------------------


def _schema_fields(df: DataFrame, cols) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined, or cut, to about ``rows`` rows each."""
    held, n = [], 0
    for b in batches:
        for s in range(0, b.num_rows, rows):
            held.append(b.slice(s, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def model_kernels(spark: SparkSession, model: SaeParams | StoredModel, budget: int):
    """What a task needs: rows at once, and functions that give the top k of a
    matrix of rows, decode it, and predict from all latents but given ones."""
    if isinstance(model, SaeParams) and model.nbytes > budget:
        model = store_params(spark, model)
    if isinstance(model, StoredModel):
        return max(1, ROWS_BYTES // (8 * model.d_model)), model.top_k, model.decode, model.decode_unused
    shared, k = spark.sparkContext.broadcast((model.w_enc, model.b_enc, model.w_dec, model.b_dec)), model.k

    def top_k(x: np.ndarray):
        w_enc, b_enc, _, b_dec = shared.value
        return topk_select(np.maximum(encode_dense(x, w_enc, b_enc, b_dec), 0.0), k)

    def decode(ids: np.ndarray, vals: np.ndarray):
        _, _, w_dec, b_dec = shared.value
        return np.einsum("nk,nkd->nd", vals, w_dec[ids]) + b_dec

    def unused(x: np.ndarray, active: np.ndarray):
        w_enc, b_enc, w_dec, b_dec = shared.value
        dead = np.setdiff1d(np.arange(w_enc.shape[1]), active)
        return np.maximum(encode_dense(x, w_enc[:, dead], b_enc[dead], b_dec), 0.0) @ w_dec[dead]

    return _chunk_rows(model.d_sae), top_k, decode, unused


def sae_features(
    df: DataFrame,
    params: SaeParams | StoredModel,
    id_col: str,
    x_col: str,
    keep: tuple[str, ...] = (),
    budget: int = DEFAULT_BROADCAST_BUDGET,
) -> DataFrame:
    """J9 + K1: sparse top-k features, k rows per input row.

    Output columns: ``keep..., id_col, latent_id LONG, rank INT (0-based),
    value DOUBLE`` (value = relu(z), zeros kept).
    """
    keep = tuple(c for c in keep if c != id_col)
    in_cols = [id_col, *keep] + ([x_col] if x_col not in keep else [])
    out_schema = T.StructType(
        _schema_fields(df, (*keep, id_col))
        + [
            T.StructField("latent_id", T.LongType(), False),
            T.StructField("rank", T.IntegerType(), False),
            T.StructField("value", T.DoubleType(), False),
        ]
    )
    import pyspark.sql.pandas.types as ptypes

    arrow_schema = ptypes.to_arrow_schema(out_schema)
    at_once, top_k, _, _ = model_kernels(df.sparkSession, params, budget)
    d_model, pass_cols = params.d_model, [*keep, id_col]

    def fn(batches):
        for rb in _gathered(batches, at_once):
            ids, vals = top_k(list_matrix(rb.column(x_col), d_model))
            n, kq = ids.shape
            take = pa.array(np.repeat(np.arange(n), kq))
            cols = [rb.column(c).take(take) for c in pass_cols]
            cols += [
                pa.array(ids.reshape(-1), type=pa.int64()),
                pa.array(np.tile(np.arange(kq, dtype=np.int32), n), type=pa.int32()),
                pa.array(vals.reshape(-1), type=pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return df.select(*in_cols).mapInArrow(fn, out_schema)


def _spread_around_mean(m: np.ndarray) -> np.ndarray:
    """Per row the sum of squared differences from the row's mean."""
    return ((m - m.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)


def sae_forward_rows(
    df: DataFrame,
    params: SaeParams | StoredModel,
    id_col: str,
    x_col: str,
    keep: tuple[str, ...] = (),
    with_x_hat: bool = False,
    budget: int = DEFAULT_BROADCAST_BUDGET,
) -> DataFrame:
    """X5 + X6: encode -> top-k -> decode, one output row per input row.

    Output: ``keep..., id, topk_ids ARRAY<LONG>, topk_values ARRAY<DOUBLE>,
    [x_hat ARRAY<DOUBLE>], x_sum, x_sq, x_m2, r_sum, r_sq, r_m2 DOUBLE, l0 INT``
    where r = x - x_hat, m2 = squared differences from the row's own mean (so
    that variances merge without cancellation) and l0 = number of strictly
    positive features.
    """
    keep = tuple(c for c in keep if c != id_col)
    pass_cols = [*keep, id_col]
    fields = _schema_fields(df, pass_cols) + [
        T.StructField("topk_ids", T.ArrayType(T.LongType(), False)),
        T.StructField("topk_values", T.ArrayType(T.DoubleType(), False)),
    ]
    if with_x_hat:
        fields.append(T.StructField("x_hat", T.ArrayType(T.DoubleType(), False)))
    fields += [
        T.StructField(n, T.DoubleType(), False) for n in ("x_sum", "x_sq", "x_m2", "r_sum", "r_sq", "r_m2")
    ] + [T.StructField("l0", T.IntegerType(), False)]
    out_schema = T.StructType(fields)
    import pyspark.sql.pandas.types as ptypes

    arrow_schema = ptypes.to_arrow_schema(out_schema)
    at_once, top_k, decode, _ = model_kernels(df.sparkSession, params, budget)
    d_model = params.d_model

    def fn(batches):
        for rb in _gathered(batches, at_once):
            x = list_matrix(rb.column(x_col), d_model)
            ids, vals = top_k(x)
            x_hat = decode(ids, vals)
            r = x - x_hat
            n, kq = ids.shape
            cols = [rb.column(c) for c in pass_cols]
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * kq, kq, dtype=np.int32)), pa.array(ids.reshape(-1))))
            cols.append(matrix_list(vals))
            if with_x_hat:
                cols.append(matrix_list(x_hat))
            for m in (x, r):
                cols += [pa.array(m.sum(1)), pa.array((m * m).sum(1)), pa.array(_spread_around_mean(m))]
            cols.append(pa.array((vals > 0).sum(1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    in_cols = [id_col, *keep] + ([x_col] if x_col not in keep else [])
    return df.select(*in_cols).mapInArrow(fn, out_schema)


def params_from_latents(latents: DataFrame, b_dec, k: int, budget: int = DEFAULT_BROADCAST_BUDGET) -> SaeParams:
    """Collect an R6 latent table (latents 0 to n - 1) into driver-side
    parameters, at most ``budget`` bytes a job (a larger model stays a
    ``StoredModel``)."""
    n, d_model = latents.count(), len(b_dec)
    p = SaeParams(
        w_enc=np.empty((d_model, n)), b_enc=np.empty(n), w_dec=np.empty((n, d_model)), b_dec=np.asarray(b_dec, dtype=np.float64), k=k
    )
    for t in latent_slices(latents, n, (2 * d_model + 3) * 8, budget):
        at = t["latent_id"].to_numpy()
        p.w_enc[:, at] = list_matrix(t["w_enc"], d_model).T
        p.w_dec[at] = list_matrix(t["w_dec"], d_model)
        for name in ("b_enc", "activation_count", "steps_since"):
            getattr(p, name)[at] = t[name].to_numpy()
    return p


def latent_slices(latents: DataFrame, n: int, row_bytes: int, budget: int = DEFAULT_BROADCAST_BUDGET) -> Iterator[pa.Table]:
    """The table of latents 0 to n - 1 as Arrow tables of at most ``budget`` bytes each."""
    for lo, hi in latent_ranges(n, row_bytes, budget):
        yield latents.filter(F.col("latent_id").between(lo, hi - 1)).toArrow()


def init_params_frame(spark: SparkSession, d_model: int, d_sae: int, seed: int = 42) -> DataFrame:
    """Kaiming-uniform (a=sqrt(5)) latent table built as a Spark job.

    W_enc [d_model, d_sae] ~ U(-1/sqrt(d_sae), 1/sqrt(d_sae)) (fan_in = second
    dimension), W_dec [d_sae, d_model] ~ U(-1/sqrt(d_model), ..) then unit rows,
    biases zero.  Uniforms come from MD5 digits of (seed, matrix, i, j), so
    the table is the same for any partitioning.
    """
    from tracelab.functions.vectors import unit_norm

    def uniform(tag: int, bound: float):
        def draw(j):
            digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(tag), F.col("id"), j)), 1, 12)
            u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
            return (u * 2.0 - 1.0) * bound

        return F.transform(F.sequence(F.lit(0), F.lit(d_model - 1)), draw)

    return spark.range(d_sae).select(
        F.col("id").alias("latent_id"),
        uniform(1, 1.0 / math.sqrt(d_sae)).alias("w_enc"),
        F.lit(0.0).alias("b_enc"),
        unit_norm(uniform(2, 1.0 / math.sqrt(d_model))).alias("w_dec"),
        F.lit(0).cast("long").alias("activation_count"),
        F.lit(0).cast("long").alias("steps_since"),
    )
