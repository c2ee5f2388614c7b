"""Model and geometry artifacts (S12, S13) as plain parquet / JSON tables."""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators.fit import AdamState
from tracelab.operators.sae import SaeParams, StoredModel, latent_ranges, latent_slices, list_matrix, matrix_list, params_from_latents, write_latents
from tracelab.session import DEFAULT_BROADCAST_BUDGET

META_SCHEMA = T.StructType(
    [
        T.StructField("d_model", T.LongType()),
        T.StructField("d_sae", T.LongType()),
        T.StructField("k", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("best_l2_ratio", T.DoubleType()),
        T.StructField("b_dec", T.ArrayType(T.DoubleType())),
        T.StructField("adam_t", T.LongType()),
        T.StructField("m_b_dec", T.ArrayType(T.DoubleType())),
        T.StructField("v_b_dec", T.ArrayType(T.DoubleType())),
    ]
)

MOMENTS_SCHEMA = (
    "latent_id long, m_enc array<double>, v_enc array<double>, m_dec array<double>, v_dec array<double>, m_b_enc double, v_b_enc double"
)


MOMENT_COLUMNS = ("latent_id", "m_enc", "v_enc", "m_dec", "v_dec", "m_b_enc", "v_b_enc")


def save_model(spark: SparkSession, params: SaeParams, path: str, optimizer: AdamState | None = None, mode: str = "overwrite") -> None:
    """``latents`` table (one row per latent) + one-row ``meta`` table;
    with the optimizer state also ``moments`` (one row per latent), so that a
    fit resumes where it stopped."""
    write_latents(spark, params, posixpath.join(path, "latents"), mode)
    adam = (None, None, None)
    if optimizer is not None and optimizer.t:
        m, v = optimizer.m, optimizer.v
        matrices = (m["w_enc"].T, v["w_enc"].T, m["w_dec"], v["w_dec"])
        names = MOMENT_COLUMNS
        for lo, hi in latent_ranges(params.d_sae, (4 * params.d_model + 3) * 8):
            columns = [pa.array(np.arange(lo, hi)), *(matrix_list(np.ascontiguousarray(x[lo:hi])) for x in matrices)]
            columns += [pa.array(x["b_enc"][lo:hi]) for x in (m, v)]
            part = spark.createDataFrame(pa.table(columns, names=names), MOMENTS_SCHEMA)
            part.write.mode(mode if lo == 0 else "append").parquet(posixpath.join(path, "moments"))
        adam = (int(optimizer.t), m["b_dec"], v["b_dec"])
    save_meta(spark, path, params.b_dec, params.d_sae, params.k, params.step, params.best_l2_ratio, adam, mode)


def save_meta(spark: SparkSession, path: str, b_dec, d_sae: int, k: int, step: int, best_l2_ratio: float, adam: tuple, mode: str = "overwrite") -> None:
    """The one-row ``meta`` table: sizes, decoder bias, and (t, m, v) of the optimizer for it."""
    floats = [None if x is None else [float(v) for v in x] for x in (b_dec, *adam[1:])]
    row = (len(b_dec), int(d_sae), int(k), int(step), float(best_l2_ratio), floats[0], None if adam[0] is None else int(adam[0]), *floats[1:])
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode(mode).parquet(posixpath.join(path, "meta"))


def read_meta(spark: SparkSession, path: str):
    return spark.read.schema(META_SCHEMA).parquet(posixpath.join(path, "meta")).first()


def load_model(spark: SparkSession, path: str, budget: int = DEFAULT_BROADCAST_BUDGET) -> SaeParams:
    """Read back, at most ``budget`` bytes a job; resume continues the step counter."""
    meta = read_meta(spark, path)
    lat = spark.read.parquet(posixpath.join(path, "latents"))
    columns = ("latent_id", "w_enc", "b_enc", "w_dec", "activation_count", "steps_since")
    p = params_from_latents(lat.select(*columns), meta["b_dec"], int(meta["k"]), budget)
    p.step = int(meta["step"])
    p.best_l2_ratio = float(meta["best_l2_ratio"])
    return p


def open_model(spark: SparkSession, path: str) -> StoredModel:
    """The saved model as it lies, of any size; only its meta row is read."""
    meta = read_meta(spark, path)
    return StoredModel.of(spark.read.parquet(posixpath.join(path, "latents")), meta["b_dec"], int(meta["k"]))


def load_optimizer(spark: SparkSession, path: str, budget: int = DEFAULT_BROADCAST_BUDGET) -> AdamState:
    """The optimizer state saved with the model; a fresh one if there is none."""
    meta = read_meta(spark, path)
    if meta["adam_t"] is None:
        return AdamState()
    n, d = int(meta["d_sae"]), int(meta["d_model"])
    state = AdamState(t=int(meta["adam_t"]))
    for side, moments in (("m", state.m), ("v", state.v)):
        moments |= {"w_enc": np.empty((d, n)), "b_enc": np.empty(n), "w_dec": np.empty((n, d)), "b_dec": np.asarray(meta[f"{side}_b_dec"])}
    for t in latent_slices(spark.read.parquet(posixpath.join(path, "moments")), n, (4 * d + 3) * 8, budget):
        at = t["latent_id"].to_numpy()
        for side, moments in (("m", state.m), ("v", state.v)):
            moments["w_enc"][:, at] = list_matrix(t[f"{side}_enc"], d).T
            moments["w_dec"][at] = list_matrix(t[f"{side}_dec"], d)
            moments["b_enc"][at] = t[f"{side}_b_enc"].to_numpy()
    return state


def write_geometry(summary: DataFrame, points: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Summary records (nested top features as JSON) + decoder points."""
    summary.write.mode(mode).json(posixpath.join(out, "summary"))
    points.write.mode(mode).json(posixpath.join(out, "points"))


POINT_SCHEMA = T.StructType(
    [
        T.StructField("feature_index", T.LongType()),
        T.StructField("assigned_label", T.StringType()),
        T.StructField("specificity", T.DoubleType()),
        T.StructField("mean_activation", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def read_geometry(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(posixpath.join(out, "summary")), spark.read.schema(POINT_SCHEMA).json(posixpath.join(out, "points"))


def behavior_summary_records(top: DataFrame, label_col: str = "label") -> DataFrame:
    """Summary record per label: num_steps and the ordered top features."""
    return top.groupBy(label_col).agg(
        F.first("num_steps").alias("num_steps"),
        F.sort_array(F.collect_list(F.struct("rank", F.col("latent_id").alias("feature_index"), "specificity", "mean_activation"))).alias(
            "top_features"
        ),
    )
