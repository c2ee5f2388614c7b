"""Top-K SAE fitting with the model as a table.

The latents are rows: encoder column, decoder row, bias, activity counters,
optimizer moments and the last gradient of each lie in one Parquet table that
tasks own in parts.  A step ships its batch to the tasks, not the model:

1. every task finds the top k of its own latents for each row of the batch;
   the lists of a row are merged by a shuffle of k entries a task;
2. with the winners known, every task decodes its latents' part of the
   reconstruction and of the auxiliary prediction; parts are summed;
3. with both residuals known, the gradient of a latent needs nothing but the
   batch and the latent, so each task writes its latents anew, updated by the
   *last* step's gradient and carrying this step's;
4. one small aggregate gives the gradient's norm and what the shared decoder
   bias needs.

The AdamW update (global clipping, unit decoder rows) is applied by the tasks
when they next read their latents.  The driver holds a batch (at most
``BATCH_BUDGET`` bytes of it), one number a latent at most, and scalars; a
model of any size is fitted.  Several fits (one a layer, E5) advance together:
the fit is a key of the rows and of the latents, so the number of jobs does
not depend on how many there are.

A step of a small model is milliseconds of work, and steps follow each other by
nature.  Where a fit's latents fit a task (``TASK_MODEL_BYTES``) and many steps
are to be done, a job therefore takes every fit on by a stretch of steps: a
task gets the latents of a fit and the stretch's batches (``STRETCH_BYTES`` of
vectors at most, so neither grows with the rows), and runs the same functions
as the passes above.
"""

from __future__ import annotations

import math
import pickle
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators.fit import MEANS, lr_at
from tracelab.operators.sae import BLOCK_BYTES, CHUNK_BYTES, list_matrix, matrix_list, topk_select, unit_rows
from tracelab.operators.sampling import partition_index
from tracelab.session import ensure_checkpoint_dir

#: Bytes of batch rows that one group of fits may have on the driver.
BATCH_BUDGET = 512 << 20
#: Elements of a partial sum that travel as one row.
SUM_ELEMENTS = 1 << 16
#: Bytes of vectors that a stretch of steps gives a task, and of the latents (and
#: activations) of a fit that a task may hold; fewer steps than STRETCH_STEPS are taken one by one.
STRETCH_BYTES, TASK_MODEL_BYTES, STRETCH_STEPS = 16 << 20, 64 << 20, 8
BETAS, EPSILON, MAX_NORM = (0.9, 0.999), 1e-8, 1.0

VECTORS = ("w_enc", "w_dec", "m_enc", "v_enc", "m_dec", "v_dec", "g_enc", "g_dec")
SCALARS = ("b_enc", "m_b", "v_b", "g_b", "g_sq")
COUNTERS = ("activation_count", "steps_since")
STATE = T.StructType(
    [T.StructField("fit", T.LongType()), T.StructField("latent_id", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in VECTORS]
    + [T.StructField(c, T.DoubleType()) for c in SCALARS]
    + [T.StructField(c, T.LongType()) for c in COUNTERS]
)
#: What AdamW moves: parameter, its two moments, its gradient.
MOVED = (("w_enc", "m_enc", "v_enc", "g_enc"), ("w_dec", "m_dec", "v_dec", "g_dec"), ("b_enc", "m_b", "v_b", "g_b"))


@dataclass
class Update:
    """What the tasks have yet to apply to the latents of a fit."""

    scale: float
    lr: float
    t: int
    weight_decay: float
    reset_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    reset_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a unit residual for each

    def moved(self, p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b1, b2 = BETAS
        g = g * self.scale
        m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        step = self.lr * (m / (1 - b1**self.t)) / (np.sqrt(v / (1 - b2**self.t)) + EPSILON)
        return p * (1 - self.lr * self.weight_decay) - step, m, v

    def apply(self, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p = dict(p)
        for name, m, v, g in MOVED:
            p[name], p[m], p[v] = self.moved(p[name], p[m], p[v], p[g])
        p["w_dec"] = unit_rows(p["w_dec"])
        at = np.flatnonzero(np.isin(p["latent_id"], self.reset_ids))
        if len(at):
            unit = self.reset_rows[np.searchsorted(self.reset_ids, p["latent_id"][at])]
            p["w_enc"][at] = p["w_dec"][at] = unit
            p["b_enc"][at] = 0.0
            for c in COUNTERS:
                p[c] = p[c].copy()
                p[c][at] = 0
        return p


@dataclass
class Fit:
    """The driver's side of one fit: the decoder bias with its moments, and counts."""

    b_dec: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: int = 0
    step: int = 0
    best_l2_ratio: float = float("inf")
    update: Update | None = None


@dataclass
class TableModel:
    """Fits over one table of latents (``path``; see STATE)."""

    spark: SparkSession
    path: str
    k: int
    d_sae: int
    fits: dict[int, Fit]

    def table(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.path)

    @classmethod
    def start(cls, latents: DataFrame, b_dec: dict[int, np.ndarray], k: int) -> TableModel:
        """Every fit from the same latents (latent_id, w_enc, b_enc, w_dec) and a decoder bias of its own."""
        d = len(next(iter(b_dec.values())))
        zeros, zero = F.array_repeat(F.lit(0.0), d), F.lit(0.0)
        known = set(latents.columns)
        columns = {c: F.col(c) if c in known else zeros for c in VECTORS} | {c: F.col(c) if c in known else zero for c in SCALARS}
        columns |= {c: F.col(c) if c in known else F.lit(0).cast("long") for c in COUNTERS}
        fits = F.explode(F.array(*[F.lit(int(f)).cast("long") for f in b_dec])).alias("fit")
        each = latents.select("*", fits).select("fit", "latent_id", *[c.alias(n) for n, c in columns.items()])
        spark = latents.sparkSession
        n = spark.sparkContext.defaultParallelism
        path = _written(each.repartition(n, "fit", "latent_id"))
        new = {int(f): Fit(np.array(b, np.float64), np.zeros(d), np.zeros(d)) for f, b in b_dec.items()}
        d_sae = spark.read.schema(STATE).parquet(path).count() // len(b_dec)
        return cls(spark, path, k, d_sae, new)

    def latents(self) -> DataFrame:
        """The table with every update applied (gradients are spent)."""
        updates = self.spark.sparkContext.broadcast({f: x.update for f, x in self.fits.items()})

        def fn(batches):
            for f, p in _parts(batches, 1 << 12):
                yield _state_batch(f, p if updates.value[f] is None else updates.value[f].apply(p))

        return self.table().mapInArrow(fn, STATE)

    def save(self, path: str, fit: int = 0, mode: str = "overwrite") -> None:
        """One fit as model, moments and meta tables (``load_model``,
        ``load_optimizer``, ``open_model`` and ``resume`` read them)."""
        from tracelab.sources.artifacts import MOMENT_COLUMNS, save_meta

        mine = self.latents().filter(F.col("fit") == fit)
        order = mine.repartitionByRange("latent_id").sortWithinPartitions("latent_id")
        kept = order.select("latent_id", "w_enc", "b_enc", "w_dec", *COUNTERS)
        kept.write.mode(mode).option("parquet.block.size", BLOCK_BYTES).parquet(posixpath.join(path, "latents"))
        moments = order.select("latent_id", "m_enc", "v_enc", "m_dec", "v_dec", F.col("m_b").alias("m_b_enc"), F.col("v_b").alias("v_b_enc"))
        moments.select(*MOMENT_COLUMNS).write.mode(mode).option("parquet.block.size", BLOCK_BYTES).parquet(posixpath.join(path, "moments"))
        x = self.fits[fit]
        save_meta(self.spark, path, x.b_dec, self.d_sae, self.k, x.step, x.best_l2_ratio, (x.t, x.m, x.v), mode)

    @classmethod
    def resume(cls, spark: SparkSession, path: str) -> TableModel:
        """A saved fit, to be continued where it stopped; no vector of a latent is read on the driver."""
        from tracelab.sources.artifacts import read_meta

        meta = read_meta(spark, path)
        latents = spark.read.parquet(posixpath.join(path, "latents"))
        if meta["adam_t"] is not None:
            moments = spark.read.parquet(posixpath.join(path, "moments"))
            latents = latents.join(moments.withColumnsRenamed({"m_b_enc": "m_b", "v_b_enc": "v_b"}), "latent_id")
        out = cls.start(latents, {0: np.asarray(meta["b_dec"])}, int(meta["k"]))
        x = out.fits[0]
        x.step, x.best_l2_ratio = int(meta["step"]), float(meta["best_l2_ratio"])
        if meta["adam_t"] is not None:
            x.t, x.m, x.v = int(meta["adam_t"]), np.asarray(meta["m_b_dec"]), np.asarray(meta["v_b_dec"])
        return out


def _written(df: DataFrame, *folders: str) -> str:
    """A new table in the shared folder; it goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = posixpath.join(ensure_checkpoint_dir(spark), f"fit-{uuid.uuid4().hex}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.option("parquet.block.size", BLOCK_BYTES).partitionBy(*folders).parquet(path)
    return path


def _dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that ``_written`` made and a later one replaced."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(fit, latents as arrays) of at most ``rows`` latents each."""
    for b in batches:
        fits = b.column("fit").to_numpy()
        for f in np.unique(fits):
            mine = np.flatnonzero(fits == f)
            for s in range(0, len(mine), rows):
                part = b.take(pa.array(mine[s : s + rows]))
                named = {n: part.column(n) for n in part.schema.names if n != "fit"}
                yield int(f), {n: list_matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for n, c in named.items()}


def _state_batch(fit: int, p: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(p["latent_id"])
    columns = [pa.array(np.full(n, fit)), pa.array(p["latent_id"])]
    columns += [matrix_list(np.ascontiguousarray(p[c])) for c in VECTORS] + [pa.array(p[c]) for c in (*SCALARS, *COUNTERS)]
    return pa.RecordBatch.from_arrays(columns, names=STATE.names)


# ---------------------------------------------------------------------------
# Passes over the table
# ---------------------------------------------------------------------------


@dataclass
class Batch:
    """One fit's rows of a step, and what the passes found out about them."""

    x: np.ndarray
    b_dec: np.ndarray
    update: Update | None
    ids: np.ndarray | None = None  # top k
    vals: np.ndarray | None = None
    active: np.ndarray | None = None  # sorted ids in any row's top k
    g_hat: np.ndarray | None = None  # gradient of the loss by the reconstruction
    g_aux: np.ndarray | None = None  # and by the auxiliary prediction

    def encode(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.maximum((self.x - self.b_dec) @ p["w_enc"].T + p["b_enc"], 0.0)

    def picked(self, latents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among the given latents, value) of the top-k entries that are theirs."""
        order = np.argsort(latents)
        place = np.minimum(np.searchsorted(latents, self.ids, sorter=order), len(latents) - 1)
        place = order[place]
        rows, cols = np.nonzero(latents[place] == self.ids)
        return rows, place[rows, cols], self.vals[rows, cols]

    def unused(self, latents: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~np.isin(latents, self.active))

    def top(self, p: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, values) of each row's top k among the latents ``p``."""
        order = np.argsort(p["latent_id"])
        at, vals = topk_select(self.encode(p)[:, order], k)
        return p["latent_id"][order][at], vals

    def decoded(self, p: dict[str, np.ndarray], out: np.ndarray) -> None:
        """Add what the latents ``p`` give to the reconstruction and the auxiliary prediction."""
        rows, at, vals = self.picked(p["latent_id"])
        np.add.at(out[0], rows, vals[:, None] * p["w_dec"][at])
        if len(dead := self.unused(p["latent_id"])):
            out[1] += self.encode({"w_enc": p["w_enc"][dead], "b_enc": p["b_enc"][dead]}) @ p["w_dec"][dead]

    def residuals(self, parts: np.ndarray, d_sae: int, aux_weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of the reconstruction and of the auxiliary prediction; sets the gradients by both."""
        r = parts[0] + self.b_dec - self.x
        q = parts[1] + r
        self.g_aux = 2.0 * aux_weight * q / self.x.size
        # The auxiliary loss sees the reconstruction's residual, so it moves the winners too (nothing is detached).
        self.g_hat = 2.0 * r / self.x.size + (self.g_aux if len(self.active) < d_sae else 0.0)
        return r, q

    def with_gradients(self, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The latents ``p`` with their gradients, counters moved on."""
        p, latents = dict(p), p["latent_id"]
        g_dec, dz = np.zeros_like(p["w_dec"]), np.zeros((len(self.x), len(latents)))
        rows, at, vals = self.picked(latents)
        np.add.at(g_dec, at, vals[:, None] * self.g_hat[rows])
        dz[rows, at] = np.einsum("ij,ij->i", self.g_hat[rows], p["w_dec"][at]) * (vals > 0)
        if len(dead := self.unused(latents)):
            z = self.encode({"w_enc": p["w_enc"][dead], "b_enc": p["b_enc"][dead]})
            g_dec[dead] += z.T @ self.g_aux
            dz[:, dead] = (self.g_aux @ p["w_dec"][dead].T) * (z > 0)
        p["g_dec"], p["g_enc"], p["g_b"] = g_dec, dz.T @ (self.x - self.b_dec), dz.sum(0)
        p["g_sq"] = (p["g_dec"] ** 2).sum(1) + (p["g_enc"] ** 2).sum(1) + p["g_b"] ** 2
        seen = np.isin(latents, self.active)
        p["activation_count"] = p["activation_count"] + seen
        p["steps_since"] = np.where(seen, 0, p["steps_since"] + 1)
        return p


def _rows_of(step: dict[int, Batch]) -> int:
    return max(1, CHUNK_BYTES // (8 * max(1, max(len(b.x) for b in step.values()))))


def _live(batches, step: dict[int, Batch]) -> Iterator[tuple[int, dict[str, np.ndarray], Batch]]:
    """The parts of the fits that take this step, with their updates applied."""
    for f, p in _parts(batches, _rows_of(step)):
        if f in step:
            b = step[f]
            yield f, (p if b.update is None else b.update.apply(p)), b


READ = ("fit", "latent_id", *(c for c in VECTORS), "b_enc", "m_b", "v_b", "g_b", *COUNTERS)


def find_top(model: TableModel, step: dict[int, Batch]) -> None:
    """Pass 1: the top k of every row, and the latents in any of them."""
    shared = model.spark.sparkContext.broadcast(step)
    k = model.k

    def fn(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for f, p, b in _live(batches, shared.value):
            ids, vals = b.top(p, k)
            if f in best:
                ids, vals = np.concatenate([best[f][0], ids], axis=1), np.concatenate([best[f][1], vals], axis=1)
                first = np.lexsort((ids, -vals), axis=-1)[:, :k]
                ids, vals = np.take_along_axis(ids, first, axis=1), np.take_along_axis(vals, first, axis=1)
            best[f] = ids, vals
        for f, (ids, vals) in best.items():
            n, kk = ids.shape
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * kk)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (0.0 - vals, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f)), pa.array(np.arange(n, dtype=np.int32)), *lists], names=["fit", "row", "neg", "id"])

    found = model.table().select(*READ).mapInArrow(fn, "fit long, row int, neg array<double>, id array<long>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("neg", "id")))
    merged = found.groupBy("fit", "row").agg(F.slice(F.array_sort(pairs), 1, k).alias("top")).select("fit", "row", "top.neg", "top.id").toArrow()
    fits, rows = merged["fit"].to_numpy(), merged["row"].to_numpy()
    ids, neg = list_matrix(merged["id"]).astype(np.int64), list_matrix(merged["neg"])
    for f, b in step.items():
        mine = np.flatnonzero(fits == f)
        mine = mine[np.argsort(rows[mine])]
        b.ids, b.vals = ids[mine], 0.0 - neg[mine]
        b.active = np.unique(b.ids)
    shared.destroy()


def _summed(df: DataFrame, keys: list[str]) -> pa.Table:
    """The sum of the arrays ``s`` by key, added up as matrices in tasks."""
    schema = T.StructType([df.schema[c] for c in keys] + [df.schema["s"]])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = list_matrix(table["s"]).sum(axis=0, keepdims=True)
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [matrix_list(total)], names=[*keys, "s"])

    return df.groupBy(*keys).applyInArrow(add, schema).toArrow()


def decode_all(model: TableModel, step: dict[int, Batch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pass 2: (reconstruction without the bias, prediction by the unused latents) of each fit's rows."""
    shared = model.spark.sparkContext.broadcast(step)

    def fn(batches):
        total: dict[int, np.ndarray] = {}
        for f, p, b in _live(batches, shared.value):
            b.decoded(p, total.setdefault(f, np.zeros((2, *b.x.shape))))
        for f, out in total.items():
            flat = out.ravel()
            for i in range(0, len(flat), SUM_ELEMENTS):
                piece = flat[None, i : i + SUM_ELEMENTS]
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([i // SUM_ELEMENTS], pa.int32()), matrix_list(piece)], names=["fit", "part", "s"])

    parts = _summed(model.table().select(*READ).mapInArrow(fn, "fit long, part int, s array<double>"), ["fit", "part"])
    fits, order, s = parts["fit"].to_numpy(), parts["part"].to_numpy(), parts["s"].to_pylist()
    out = {}
    for f, b in step.items():
        mine = sorted(np.flatnonzero(fits == f), key=lambda i: order[i])
        out[f] = tuple(np.concatenate([np.asarray(s[i]) for i in mine]).reshape(2, *b.x.shape))
    shared.destroy()
    return out


def write_gradients(model: TableModel, step: dict[int, Batch]) -> str:
    """Pass 3: the table anew: updates applied, counters moved on, gradients of this step."""
    shared = model.spark.sparkContext.broadcast(step)

    def fn(batches):
        for f, p in _parts(batches, _rows_of(shared.value)):
            b = shared.value.get(f)
            if b is None:
                yield _state_batch(f, p)
                continue
            p = b.with_gradients(p if b.update is None else b.update.apply(p))
            yield _state_batch(f, p)

    path = _written(model.table().mapInArrow(fn, STATE))
    shared.destroy()
    return path


def _sums(p: dict[str, np.ndarray], threshold: int) -> np.ndarray:
    return np.concatenate([[p["g_sq"].sum(), (p["steps_since"] > threshold).sum()], p["g_b"] @ p["w_enc"]])


def gradient_sums(model: TableModel, threshold: int) -> dict[int, np.ndarray]:
    """Pass 4, by fit: squared norm of the gradient, latents unused for more than
    ``threshold`` steps, and the sum of encoder columns by bias gradient."""

    def fn(batches):
        total: dict[int, np.ndarray] = {}
        for f, p in _parts(batches, 1 << 14):
            total[f] = total.get(f, 0) + _sums(p, threshold)
        for f, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f]), matrix_list(s[None])], names=["fit", "s"])

    read = model.table().select("fit", "w_enc", "g_b", "g_sq", "steps_since")
    sums = _summed(read.mapInArrow(fn, "fit long, s array<double>"), ["fit"])
    return {f: np.asarray(s) for f, s in zip(sums["fit"].to_pylist(), sums["s"].to_pylist(), strict=True)}


# ---------------------------------------------------------------------------
# Fitting
# ---------------------------------------------------------------------------


def prepare_fit_batches(df: DataFrame, x_col: str, key_col: str, batch_size: int, fit_col: str | None = None, seed: int | None = None, epoch: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """W3 batches by fit (fit, batch, pos, x), written once to the shared folder,
    and the rows of each fit.  With a seed the rows of an epoch come in the
    order of a hash of (seed, epoch, key), else in the order of the key."""
    fit = F.lit(0).cast("long") if fit_col is None else F.col(fit_col).cast("long")
    rows = df.select(fit.alias("fit"), F.col(key_col).alias("key"), F.col(x_col).alias("x"))
    order = ["fit", "key"]
    if seed is not None:
        rows, order = rows.withColumn("_order", F.xxhash64(F.lit(seed), F.lit(epoch), "key")), ["fit", "_order", "key"]
    counts = {int(r["fit"]): r["count"] for r in rows.groupBy("fit").count().collect()}
    if not counts:
        return rows.select("fit", F.lit(0).alias("batch"), F.lit(0).alias("pos"), "x"), {}
    first, before = [], 0
    for f in sorted(counts):
        first += [F.lit(f).cast("long"), F.lit(before).cast("long")]
        before += counts[f]
    at = F.col("_idx") - F.element_at(F.create_map(*first), F.col("fit"))
    b = partition_index(rows, order, "_idx").select("fit", F.floor(at / batch_size).cast("long").alias("batch"), (at % batch_size).alias("pos"), "x")
    spark = df.sparkSession
    path = _written(b.repartitionByRange("batch", "fit").sortWithinPartitions("batch", "fit"))
    return spark.read.parquet(path), counts


def residual_draws(r: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """``n`` rows drawn with probability proportional to squared error, as
    unit residuals (x minus reconstruction); none if no row has an error."""
    w = (r * r).sum(1)
    if not w.sum() > 0:
        return np.zeros((0, r.shape[1]))
    u = np.random.default_rng(seed).random(n) * w.sum()
    return unit_rows(-r[np.minimum(np.searchsorted(np.cumsum(w), u, side="right"), len(w) - 1)])


def fit_table(
    df: DataFrame,
    model: TableModel,
    x_col: str,
    key_col: str,
    steps: int | None = None,
    batch_size: int = 4096,
    fit_col: str | None = None,
    lr: float = 5e-5,
    warmup_steps: int = 0,
    total_steps: int | None = None,
    aux_weight: float = 1 / 32,
    weight_decay: float = 0.0,
    dead_threshold: int = 10000,
    dead_check_interval: int = 2500,
    resample_trigger: float = 0.1,
    resample: bool = True,
    seed: int = 42,
    shuffle: bool = False,
    log_interval: int = 100,
    checkpoint_dir: str | None = None,
    checkpoint_interval: int = 10000,
) -> list[dict]:
    """Move every fit of ``model`` on by ``steps`` steps (None: one
    epoch of its own rows) over batches of its rows, in key order or (``shuffle``)
    in a new seeded order each epoch.  ``fit_col`` says which fit a row belongs to.

    Every ``log_interval`` steps a step's metrics carry the means of the interval
    (``mean_*``); the lowest mean l2 ratio is kept.  With ``checkpoint_dir`` (a
    shared folder) the fits are saved every ``checkpoint_interval`` steps and at
    the end, in a folder by fit if there are several.
    Returns one record per fit and step."""
    d = len(next(iter(model.fits.values())).b_dec)
    prepared: dict[int, DataFrame] = {}

    def batches_of(epoch: int) -> DataFrame:
        key = epoch if shuffle else 0
        if key not in prepared:
            prepared[key] = prepare_fit_batches(df, x_col, key_col, batch_size, fit_col, seed if shuffle else None, key)[0]
        return prepared[key]

    first, counts = prepare_fit_batches(df, x_col, key_col, batch_size, fit_col, seed if shuffle else None, 0)
    prepared[0] = first
    counts = {f: n for f, n in counts.items() if f in model.fits}
    if not counts:
        raise ValueError("no rows to fit on")
    n_batches = {f: -(-n // batch_size) for f, n in counts.items()}
    wanted = {f: n_batches[f] if steps is None else steps for f in counts}
    group = max(1, BATCH_BUDGET // (8 * 4 * batch_size * d))  # fits whose batches the driver holds together
    rule = Rule(n_batches, total_steps or max(wanted.values()), lr, warmup_steps, aux_weight, weight_decay, dead_threshold, dead_check_interval, resample_trigger, resample, seed)
    held = 8 * max(len(VECTORS) * model.d_sae * d, batch_size * model.d_sae)
    stretch = max(1, STRETCH_BYTES // (8 * batch_size * d)) if held <= TASK_MODEL_BYTES and max(wanted.values()) >= STRETCH_STEPS else 1
    log: list[tuple[int, int, dict]] = []
    done = dict.fromkeys(counts, 0)
    running: dict[int, list] = {f: [] for f in counts}
    while taking := sorted(f for f in counts if done[f] < wanted[f]):
        found: list[dict] = []
        if stretch > 1:  # to the end of the epoch or to the next checkpoint at most
            ends = {f: [n_batches[f] - model.fits[f].step % n_batches[f], wanted[f] - done[f]] for f in taking}
            if checkpoint_dir and checkpoint_interval:
                ends = {f: [*e, checkpoint_interval - model.fits[f].step % checkpoint_interval] for f, e in ends.items()}
            found = _stretch(model, {f: min(stretch, *e) for f, e in ends.items()}, batches_of, rule)
        else:
            for i in range(0, len(taking), group):
                found += _step(model, taking[i : i + group], batches_of, rule)
        for m in found:
            f = m["fit"]
            kept = running[f]
            kept.append([m[name] for name in MEANS])
            if log_interval and m["step"] % log_interval == 0:
                m |= {f"mean_{name}": float(x) for name, x in zip(MEANS, np.mean(kept, axis=0), strict=True)}
                kept.clear()
                model.fits[f].best_l2_ratio = min(model.fits[f].best_l2_ratio, m["mean_l2_ratio"])
            log.append((done[f], f, m))
            done[f] += 1
        if checkpoint_dir and checkpoint_interval:
            for f in taking:
                if model.fits[f].step % checkpoint_interval == 0:
                    model.save(_checkpoint(checkpoint_dir, model, f, str(model.fits[f].step)), f)
    if checkpoint_dir:
        for f in counts:
            model.save(_checkpoint(checkpoint_dir, model, f, "final"), f)
    return [m for *_, m in sorted(log, key=lambda x: x[:2])]


def _checkpoint(folder: str, model: TableModel, fit: int, name: str) -> str:
    at = posixpath.join(folder, f"checkpoint_{name}")
    return at if len(model.fits) == 1 else posixpath.join(at, f"fit_{fit}")


@dataclass(frozen=True)
class Rule:
    """How steps move a fit on."""

    n_batches: dict[int, int]
    total: int
    lr: float
    warmup: int
    aux_weight: float
    weight_decay: float
    threshold: int
    check_every: int
    trigger: float
    resample: bool
    seed: int

    def move(self, f: int, fit: Fit, b: Batch, r: np.ndarray, q: np.ndarray, s: np.ndarray, d_sae: int, dead_ids: Callable[[], np.ndarray]) -> dict:
        """Move the driver's side of a fit by the sums ``s`` of its latents; the
        step's record.  ``dead_ids`` finds the latents unused for long."""
        has_dead = len(b.active) < d_sae
        g_b_dec = b.g_hat.sum(0) - s[2:]
        norm = math.sqrt(s[0] + float((g_b_dec * g_b_dec).sum()))
        cur_lr = lr_at(fit.step, self.lr, self.warmup, self.total)
        fit.t += 1
        fit.update = Update(min(1.0, MAX_NORM / (norm + 1e-6)), cur_lr, fit.t, self.weight_decay)
        fit.b_dec, fit.m, fit.v = fit.update.moved(fit.b_dec, fit.m, fit.v, g_b_dec)
        fit.step += 1
        l_recon = float((r * r).sum()) / r.size
        l_aux = float((q * q).sum()) / q.size if has_dead else 0.0
        x2 = (b.x * b.x).sum(1)
        m = {
            "fit": f,
            "step": fit.step,
            "batch": (fit.step - 1) % self.n_batches[f],
            "n_rows": len(r),
            "n_dead": d_sae - len(b.active),
            "loss": l_recon + self.aux_weight * l_aux,
            "l_recon": l_recon,
            "l_aux": l_aux,
            "l2_ratio": float(((r * r).sum(1) / np.where(x2 > 0, x2, np.nan)).sum()) / len(r),
            "l0": float((b.vals > 0).sum()) / len(r),
            "lr": cur_lr,
            "grad_norm": norm,
        }
        if self.check_every and fit.step % self.check_every == 0:
            m["dead_ratio"] = s[1] / d_sae
            if self.resample and m["dead_ratio"] > self.trigger:
                dead = dead_ids()
                rows = residual_draws(r, len(dead), [self.seed, f, fit.step])
                if len(rows):
                    fit.update.reset_ids, fit.update.reset_rows = np.sort(dead), rows
                m["resampled"] = len(rows)
        return m


def _rows_at(batches_of: Callable[[int], DataFrame], at: dict[int, tuple[int, int, int]]) -> DataFrame:
    """The rows of each fit's (epoch, first batch, batches)."""
    out = None
    for epoch in sorted({e for e, *_ in at.values()}):
        wanted = F.lit(False)
        for first, n in sorted({x[1:] for x in at.values() if x[0] == epoch}):
            of = [f for f, x in at.items() if x == (epoch, first, n)]
            wanted = wanted | (F.col("batch").between(first, first + n - 1) & F.col("fit").isin(of))
        part = batches_of(epoch).filter(wanted)
        out = part if out is None else out.unionByName(part)
    return out


def _stretch(model: TableModel, steps: dict[int, int], batches_of: Callable[[int], DataFrame], rule: Rule) -> list[dict]:
    """As many steps of each fit as said, in one job: a task takes the latents
    of a fit and its batches, and writes the latents anew beside the records
    and the fit's new state."""
    at = {f: (*divmod(model.fits[f].step, rule.n_batches[f]), n) for f, n in steps.items()}
    shared = model.spark.sparkContext.broadcast({f: model.fits[f] for f in steps})
    k, d_sae = model.k, model.d_sae
    schema = T.StructType([*STATE.fields, T.StructField("note", T.BinaryType()), T.StructField("kind", T.StringType())])

    def state(f: int, p: dict[str, np.ndarray]) -> pa.Table:
        n = len(p["latent_id"])
        return pa.Table.from_batches([_state_batch(f, p)]).append_column("note", pa.nulls(n, pa.binary())).append_column("kind", pa.array(["latents"] * n))

    def run(key: tuple, rows: pa.Table, latents: pa.Table) -> pa.Table:
        f = key[0].as_py()
        p = {n: list_matrix(c) if pa.types.is_list(c.type) else c.to_numpy() for n, c in zip(latents.column_names, latents.columns, strict=True) if n != "fit"}
        if not rows.num_rows:
            return state(f, p)
        fit, log = shared.value[f], []
        rows = rows.sort_by([("batch", "ascending"), ("pos", "ascending")])
        number, x = rows["batch"].to_numpy(), list_matrix(rows["x"])
        cuts = np.flatnonzero(np.diff(number)) + 1
        for part in np.split(x, cuts):
            if fit.update is not None:
                p = fit.update.apply(p)
            b = Batch(part, fit.b_dec, None)
            b.ids, b.vals = b.top(p, k)
            b.active = np.unique(b.ids)
            parts = np.zeros((2, *part.shape))
            b.decoded(p, parts)
            r, q = b.residuals(parts, d_sae, rule.aux_weight)
            p = b.with_gradients(p)
            log.append(rule.move(f, fit, b, r, q, _sums(p, rule.threshold), d_sae, lambda p=p: p["latent_id"][p["steps_since"] > rule.threshold]))
        note = {"fit": pa.array([f]), "note": pa.array([pickle.dumps((fit, log))], pa.binary()), "kind": pa.array(["notes"])}
        out = state(f, p)
        return pa.concat_tables([out, pa.table([note.get(c.name, pa.nulls(1, c.type)) for c in out.schema], schema=out.schema)])

    rows = _rows_at(batches_of, at)
    old = model.path
    path = _written(rows.groupBy("fit").cogroup(model.table().groupBy("fit")).applyInArrow(run, schema), "kind")
    notes = model.spark.read.schema("fit long, note binary").parquet(posixpath.join(path, "kind=notes")).collect()
    model.path = posixpath.join(path, "kind=latents")
    _dropped(model.spark, old)
    shared.destroy()
    log = []
    for r in notes:
        model.fits[r.fit], found = pickle.loads(r.note)
        log += found
    return log


def _step(model: TableModel, taking: list[int], batches_of: Callable[[int], DataFrame], rule: Rule) -> list[dict]:
    """One step of the fits in ``taking``."""
    step: dict[int, Batch] = {}
    at = {f: (*divmod(model.fits[f].step, rule.n_batches[f]), 1) for f in taking}
    got = _rows_at(batches_of, at).toArrow().sort_by([("fit", "ascending"), ("pos", "ascending")])
    fits = got["fit"].to_numpy()
    for f in np.unique(fits).tolist():
        mine = np.flatnonzero(fits == f)
        fit = model.fits[f]
        step[f] = Batch(list_matrix(got["x"].slice(mine[0], len(mine))), fit.b_dec, fit.update)
    find_top(model, step)
    parts = decode_all(model, step)
    found = {}
    for f, b in step.items():
        b.update = model.fits[f].update
        found[f] = b.residuals(parts[f], model.d_sae, rule.aux_weight)
    old, model.path = model.path, write_gradients(model, step)
    sums = gradient_sums(model, rule.threshold)
    _dropped(model.spark, old)

    def dead_of(f: int) -> np.ndarray:
        return model.table().filter((F.col("fit") == f) & (F.col("steps_since") > rule.threshold)).select("latent_id").toArrow()["latent_id"].to_numpy()

    return [rule.move(f, model.fits[f], b, *found[f], sums[f], model.d_sae, lambda f=f: dead_of(f)) for f, b in step.items()]
