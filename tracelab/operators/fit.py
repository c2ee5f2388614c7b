"""Data-parallel Top-K SAE fitting of models that the driver holds.

One optimisation step = two Spark passes over the step's batch:

1. the set of latents selected by any row of the batch (needed by every
   partition for the auxiliary loss: latents outside it predict the
   residual);
2. per partition, the sum of the gradient of the batch loss over its rows
   (numpy inside ``mapInArrow``), emitted in fixed-size chunks and summed
   per chunk across partitions.

The driver then clips the global gradient norm, applies AdamW with a linear
warm-up + cosine schedule, renormalises decoder rows and updates the latent
activity counters.  The auxiliary-loss residual is *not* detached, so the
auxiliary term also moves active latents (as in the reference code).

Batches are consecutive slices of the data (W3); the batched data is written
once to the shared checkpoint folder sorted by batch, so each step reads
only its own row groups (parquet min/max pruning on ``batch``).

Sizing: gradients are model-sized and cross the driver once per step; use
for d_sae up to a few thousand.  ``table_fit`` fits a model of any size, which
never comes to the driver, and several fits together.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators.sae import SaeParams, encode_dense, list_matrix, topk_select, unit_rows
from tracelab.functions.vectors import unit_norm
from tracelab.operators.sampling import assign_batches, sample_by_weight
from tracelab.session import ensure_checkpoint_dir

CHUNK = 1 << 16
STAT_NAMES = ("n_rows", "sum_r2", "sum_aux2", "sum_l2_ratio", "sum_l0")
MEANS = ("loss", "l_recon", "l_aux", "l2_ratio", "l0")
# Each step ships the whole model to every executor; a larger one is refused.
FIT_BUDGET = 2 << 30


# ---------------------------------------------------------------------------
# numpy kernels
# ---------------------------------------------------------------------------


def batch_gradients(x: np.ndarray, p: SaeParams, dead: np.ndarray, n_elems: int, aux_weight: float):
    """Gradient sums of the batch loss over the rows ``x`` (a slice of the
    batch); ``n_elems`` = rows of the whole batch × d_model.
    Returns (grads dict, stats array)."""
    xc = x - p.b_dec
    z = xc @ p.w_enc + p.b_enc
    zr = np.maximum(z, 0.0)
    ids, vals = topk_select(zr, p.k)
    x_hat = np.einsum("nk,nkd->nd", vals, p.w_dec[ids]) + p.b_dec
    r = x_hat - x
    n, d = x.shape
    has_dead = bool(dead.any())
    G = 2.0 * r / n_elems
    if has_dead:
        zd = zr[:, dead]
        wd = p.w_dec[dead]
        q = zd @ wd + r
        G = G + 2.0 * aux_weight * q / n_elems
        H = 2.0 * aux_weight * q / n_elems
    g_wdec = np.zeros_like(p.w_dec)
    np.add.at(g_wdec, ids.reshape(-1), (vals[:, :, None] * G[:, None, :]).reshape(-1, d))
    dz = np.zeros_like(z)
    dsel = np.einsum("nd,nkd->nk", G, p.w_dec[ids]) * (vals > 0)
    np.put_along_axis(dz, ids, dsel, axis=1)
    if has_dead:
        g_wdec[dead] += zd.T @ H
        dz[:, dead] = (H @ wd.T) * (zd > 0)
    grads = {
        "w_enc": xc.T @ dz,
        "b_enc": dz.sum(0),
        "w_dec": g_wdec,
        "b_dec": G.sum(0) - (dz @ p.w_enc.T).sum(0),
    }
    x2 = (x * x).sum(1)
    stats = np.array(
        [
            n,
            float((r * r).sum()),
            float(((q * q).sum()) if has_dead else 0.0),
            float(((r * r).sum(1) / np.where(x2 > 0, x2, np.nan)).sum()),
            float((vals > 0).sum()),
        ]
    )
    return grads, stats


GRAD_ORDER = ("w_enc", "b_enc", "w_dec", "b_dec")


def flatten(grads: dict) -> np.ndarray:
    return np.concatenate([np.asarray(grads[k], dtype=np.float64).reshape(-1) for k in GRAD_ORDER])


def unflatten(vec: np.ndarray, p: SaeParams) -> dict:
    out, o = {}, 0
    for k in GRAD_ORDER:
        shape = getattr(p, k).shape
        size = int(np.prod(shape))
        out[k] = vec[o : o + size].reshape(shape)
        o += size
    return out


def lr_at(step: int, lr: float, warmup: int, total: int) -> float:
    """Linear warm-up from 1 % to 100 % over ``warmup`` steps, then cosine
    decay to 1 % of ``lr`` at ``total`` steps."""
    if warmup > 0 and step < warmup:
        return lr * (0.01 + 0.99 * step / warmup)
    t_max = max(1, total - warmup)
    t = min(step - warmup, t_max)
    eta_min = lr * 0.01
    return eta_min + (lr - eta_min) * (1 + math.cos(math.pi * t / t_max)) / 2


@dataclass
class AdamState:
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)
    t: int = 0


def adamw_update(p: SaeParams, grads: dict, state: AdamState, lr: float, betas=(0.9, 0.999), eps=1e-8, weight_decay=0.0, max_norm=1.0) -> float:
    """Clip to global norm, AdamW step in place; returns the pre-clip norm."""
    norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    scale = min(1.0, max_norm / (norm + 1e-6))
    state.t += 1
    b1, b2 = betas
    for k in GRAD_ORDER:
        g = grads[k] * scale
        if k not in state.m:
            state.m[k] = np.zeros_like(g)
            state.v[k] = np.zeros_like(g)
        state.m[k] = b1 * state.m[k] + (1 - b1) * g
        state.v[k] = b2 * state.v[k] + (1 - b2) * g * g
        mh = state.m[k] / (1 - b1**state.t)
        vh = state.v[k] / (1 - b2**state.t)
        cur = getattr(p, k)
        if weight_decay:
            cur *= 1 - lr * weight_decay
        cur -= lr * mh / (np.sqrt(vh) + eps)
    return norm


# ---------------------------------------------------------------------------
# Spark passes
# ---------------------------------------------------------------------------


def active_latents(batch: DataFrame, p: SaeParams, x_col: str, budget: int = FIT_BUDGET) -> tuple[np.ndarray, int]:
    """Pass 1: latents in the top-k of any row (≤ d_sae ids per partition,
    merged on the driver) and the batch's row count, in one job."""
    spark = batch.sparkSession
    if p.nbytes > budget:
        raise ValueError("model over the broadcast budget; fit supports broadcastable models only")
    bc = spark.sparkContext.broadcast((p.w_enc, p.b_enc, p.b_dec, p.k))
    schema = T.StructType([T.StructField("latent_id", T.LongType()), T.StructField("n", T.LongType())])

    def fn(batches):
        w_enc, b_enc, b_dec, k = bc.value
        seen = np.zeros(w_enc.shape[1], dtype=bool)
        n = 0
        for rb in batches:
            if rb.num_rows:
                x = list_matrix(rb.column(x_col))
                ids, _ = topk_select(np.maximum(encode_dense(x, w_enc, b_enc, b_dec), 0.0), k)
                seen[np.unique(ids)] = True
                n += rb.num_rows
        ids = np.nonzero(seen)[0].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(ids, -1)), pa.array(np.append(np.zeros(len(ids), dtype=np.int64), n))], names=["latent_id", "n"]
        )

    rows = batch.select(x_col).mapInArrow(fn, schema).collect()
    bc.destroy()
    ids = np.unique(np.array([r[0] for r in rows if r[0] >= 0], dtype=np.int64))
    return ids, int(sum(r[1] for r in rows))


def distributed_gradients(batch: DataFrame, p: SaeParams, x_col: str, dead: np.ndarray, n_rows: int, aux_weight: float):
    """Pass 2: gradient sums over all partitions of the batch, chunked."""
    spark = batch.sparkSession
    bc = spark.sparkContext.broadcast((p, dead))
    n_elems = n_rows * p.d_model
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        pp, dd = bc.value
        total = None
        stats = np.zeros(len(STAT_NAMES))
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x = list_matrix(rb.column(x_col), pp.d_model)
            g, s = batch_gradients(x, pp, dd, n_elems, aux_weight)
            fl = flatten(g)
            total = fl if total is None else total + fl
            stats += s
        if total is None:
            return
        allv = np.concatenate([total, stats])
        starts = list(range(0, len(allv), CHUNK))
        offs = np.array([0] + [min(len(allv), s + CHUNK) - s for s in starts]).cumsum().astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(starts), dtype=np.int64)), pa.ListArray.from_arrays(pa.array(offs), pa.array(allv))],
            names=["chunk", "v"],
        )

    parts = batch.select(x_col).mapInArrow(fn, schema)
    summed = parts.groupBy("chunk").agg(
        F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), F.size(F.first("v"))), lambda a, b: F.zip_with(a, b, lambda u, w: u + w)).alias("v")
    )
    chunks = sorted(summed.collect(), key=lambda r: r["chunk"])
    bc.destroy()
    vec = np.concatenate([np.asarray(r["v"], dtype=np.float64) for r in chunks])
    n_g = vec.size - len(STAT_NAMES)
    return unflatten(vec[:n_g], p), dict(zip(STAT_NAMES, vec[n_g:]))


def prepare_batches(
    df: DataFrame, x_col: str, key_col: str, batch_size: int, path: str | None = None, seed: int | None = None, epoch: int = 0
) -> tuple[DataFrame, int]:
    """W3 batches written once, sorted by batch, to the shared checkpoint
    folder (cuts the lineage; each step then prunes row groups).  With a seed
    the rows of an epoch come in the order of a hash of (seed, epoch, key),
    else in the order of the key."""
    spark = df.sparkSession
    path = path or posixpath.join(ensure_checkpoint_dir(spark), f"batches-{uuid.uuid4().hex}")
    rows, order = df.select(key_col, x_col), [key_col]
    if seed is not None:
        rows, order = rows.withColumn("_order", F.xxhash64(F.lit(seed), F.lit(epoch), key_col)), ["_order", key_col]
    b = assign_batches(rows, batch_size, order).select(key_col, x_col, "batch")
    b.repartitionByRange("batch").sortWithinPartitions("batch").write.option("parquet.block.size", 1 << 20).parquet(path)
    out = spark.read.parquet(path)
    n_batches = out.agg(F.max("batch")).first()[0]
    return out, (0 if n_batches is None else int(n_batches) + 1)


def residual_directions(rows: DataFrame, x_col: str, key_col: str, n: int, seed: int, buckets: int | None = None) -> DataFrame:
    """X12's draws: ``n`` rows of the forward table (with ``x_hat``), drawn with
    probability proportional to squared error, each with its unit residual.
    ``rows`` should be written once: the draws and the join read them.
    Output: draw (0..n-1), key, direction."""
    draws = sample_by_weight(rows, "r_sq", key_col, n, seed, buckets)
    residual = F.zip_with(F.col(x_col), "x_hat", lambda a, b: a.cast("double") - b)
    return draws.join(rows.select(key_col, unit_norm(residual).alias("direction")), key_col).select("draw", key_col, "direction")


def resample_dead(batch: DataFrame, p: SaeParams, x_col: str, key_col: str, threshold: int, seed: int, n: int | None = None) -> int:
    """Every dead latent (steps since activation > threshold), or the
    first ``n`` of them, gets the unit residual of a batch row drawn with
    probability ∝ squared error, as encoder column and decoder row; bias and
    counters reset.  Returns how many were reset (none if no row has an error)."""
    from tracelab.operators.sae import sae_forward_rows

    spark = batch.sparkSession
    dead_ids = np.nonzero(p.steps_since > threshold)[0][:n]
    if len(dead_ids) == 0:
        return 0
    # written once: the draws and the join read it several times
    path = posixpath.join(ensure_checkpoint_dir(spark), f"resample-{uuid.uuid4().hex}")
    rows = sae_forward_rows(batch, p, key_col, x_col, keep=(x_col,), with_x_hat=True)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    found = {int(r["draw"]): np.asarray(r["direction"]) for r in residual_directions(rows, x_col, key_col, len(dead_ids), seed).collect()}
    for i, lat in enumerate(dead_ids):
        if i not in found:
            continue
        p.w_enc[:, lat] = found[i]
        p.w_dec[lat] = found[i]
        p.b_enc[lat] = 0.0
        p.steps_since[lat] = 0
        p.activation_count[lat] = 0
    return len(found)


def fit_sae(
    df: DataFrame,
    params: SaeParams,
    x_col: str,
    key_col: str,
    steps: int | None,
    batch_size: int = 4096,
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
    state: AdamState | None = None,
    shuffle: bool = False,
    log_interval: int = 100,
    checkpoint_dir: str | None = None,
    checkpoint_interval: int = 10000,
) -> tuple[SaeParams, list[dict], AdamState]:
    """Fit the SAE for ``steps`` steps (None: one epoch, each row in one
    batch) over batches of the rows, in key order or (``shuffle``) in a new seeded order each epoch.  Resumes from
    ``params.step`` / ``state`` when given (``load_model``, ``load_optimizer``).

    Every ``log_interval`` steps the step's metrics carry the means of the
    interval (``mean_*``), and the lowest mean l2 ratio is kept in
    ``params.best_l2_ratio``.  With ``checkpoint_dir`` (a shared folder) model
    and optimizer are saved every ``checkpoint_interval`` steps
    (``checkpoint_<step>``) and at the end (``checkpoint_final``).
    Returns (params, per-step metrics, optimizer state)."""
    from tracelab.sources.artifacts import save_model

    p, spark = params, df.sparkSession
    state = state or AdamState()
    n_batches = -(-df.count() // batch_size)
    steps = n_batches if steps is None else steps
    total = total_steps or steps
    if n_batches == 0:
        raise ValueError("no rows to fit on")
    log, running, batches, prepared = [], [], None, None
    for _ in range(steps):
        epoch, b = divmod(p.step, n_batches)
        order = (seed, epoch) if shuffle else (None, 0)
        if order != prepared:
            batches, _n = prepare_batches(df, x_col, key_col, batch_size, None, *order)
            prepared = order
        batch = batches.filter(F.col("batch") == b)
        active, n_rows = active_latents(batch, p, x_col)
        dead = np.ones(p.d_sae, dtype=bool)
        dead[active] = False
        grads, st = distributed_gradients(batch, p, x_col, dead, n_rows, aux_weight)
        cur_lr = lr_at(p.step, lr, warmup_steps, total)
        norm = adamw_update(p, grads, state, cur_lr, weight_decay=weight_decay)
        p.w_dec[:] = unit_rows(p.w_dec)
        p.steps_since += 1
        p.activation_count[active] += 1
        p.steps_since[active] = 0
        p.step += 1
        n_el = n_rows * p.d_model
        l_recon = st["sum_r2"] / n_el
        l_aux = st["sum_aux2"] / n_el if (~dead).sum() < p.d_sae else 0.0
        m = {
            "step": p.step,
            "batch": b,
            "loss": l_recon + aux_weight * l_aux,
            "l_recon": l_recon,
            "l_aux": l_aux,
            "l2_ratio": st["sum_l2_ratio"] / n_rows,
            "l0": st["sum_l0"] / n_rows,
            "lr": cur_lr,
            "grad_norm": norm,
        }
        if dead_check_interval and p.step % dead_check_interval == 0:
            ratio = float((p.steps_since > dead_threshold).mean())
            m["dead_ratio"] = ratio
            if resample and ratio > resample_trigger:
                m["resampled"] = resample_dead(batch, p, x_col, key_col, dead_threshold, seed + p.step)
        running.append([m[name] for name in MEANS])
        if log_interval and p.step % log_interval == 0:
            m |= {f"mean_{name}": float(x) for name, x in zip(MEANS, np.mean(running, axis=0), strict=True)}
            running = []
            p.best_l2_ratio = min(p.best_l2_ratio, m["mean_l2_ratio"])
        log.append(m)
        if checkpoint_dir and checkpoint_interval and p.step % checkpoint_interval == 0:
            save_model(spark, p, posixpath.join(checkpoint_dir, f"checkpoint_{p.step}"), state)
    if checkpoint_dir:
        save_model(spark, p, posixpath.join(checkpoint_dir, "checkpoint_final"), state)
    return p, log, state


def metrics_frame(spark, log: list[dict]) -> DataFrame:
    """Per-step metrics as a DataFrame (A17 / W4 / T5 run on it)."""
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n in ("step", "batch") else T.DoubleType()) for n in ("step", "batch", "loss", "l_recon", "l_aux", "l2_ratio", "l0", "lr", "grad_norm")]
    )
    rows = [tuple(int(m[f.name]) if isinstance(f.dataType, T.LongType) else float(m[f.name]) for f in schema.fields) for m in log]
    return spark.createDataFrame(rows, schema)
