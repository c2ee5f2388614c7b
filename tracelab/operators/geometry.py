"""Decoder geometry: 2-D projection, cosine silhouette, behavior vectors,
steering projection, softmax / nucleus cut (A15-A20, X9, X11, W5)."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions.vectors import as_double, dot, unit_norm
from tracelab.operators.sae import list_matrix, matrix_list
from tracelab.session import ensure_checkpoint_dir


#: Groups whose label sums are broadcast.
GROUP_ROWS = 10_000


def silhouette_cosine(points: DataFrame, label_col: str = "label", x: str = "x", y: str = "y", by=()) -> DataFrame:
    """Cosine-distance silhouette of 2-D points, per group ``by``.

    Points are unit-normalized; a = mean distance to the other points of the
    own label, b = min over the other labels of the mean distance to them.
    Both come from per-label coordinate sums (1 - u·S_c/n_c), so no pair of
    points is ever formed.  Singleton labels and max(a, b) <= 0 are skipped;
    the score is null with fewer than 3 points or fewer than 2 labels.
    """
    by = [by] if isinstance(by, str) else list(by)
    n = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    den = F.greatest(n, F.lit(1e-12))
    pts = points.select(*by, F.col(label_col).alias("_lab"), (F.col(x) / den).alias("_ux"), (F.col(y) / den).alias("_uy"))
    sums = pts.groupBy(*by, "_lab").agg(F.sum("_ux").alias("sx"), F.sum("_uy").alias("sy"), F.count(F.lit(1)).alias("n"))
    per_group = sums.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("_lab").alias("lab"), "sx", "sy", "n")).alias("_labels"),
        F.count(F.lit(1)).alias("_n_labels"),
        F.sum("n").alias("_n_points"),
    )
    # One row a group (its labels' sums): a broadcast up to GROUP_ROWS groups, a shuffle join beyond.
    if by:
        few = per_group.limit(GROUP_ROWS + 1).count() <= GROUP_ROWS
        j = pts.join(F.broadcast(per_group) if few else per_group, by)
    else:
        j = pts.crossJoin(F.broadcast(per_group))  # a single row
    own = F.filter("_labels", lambda c: c["lab"] == F.col("_lab"))[0]
    uu = F.col("_ux") * F.col("_ux") + F.col("_uy") * F.col("_uy")
    a = F.lit(1.0) - (F.col("_ux") * own["sx"] + F.col("_uy") * own["sy"] - uu) / (own["n"] - 1)
    others = F.transform(
        F.filter("_labels", lambda c: c["lab"] != F.col("_lab")),
        lambda c: F.lit(1.0) - (F.col("_ux") * c["sx"] + F.col("_uy") * c["sy"]) / c["n"],
    )
    b = F.array_min(others)
    m = F.greatest(a, b)
    score = F.when((own["n"] > 1) & (F.size(others) > 0) & (m > 0), (b - a) / m)
    per_point = j.select(*by, "_n_labels", "_n_points", score.alias("_s"))
    agg = per_point.groupBy(*by).agg(
        F.avg("_s").alias("silhouette"), F.first("_n_labels").alias("_nl"), F.first("_n_points").alias("_np")
    )
    return agg.select(*by, F.when((F.col("_np") >= 3) & (F.col("_nl") >= 2), F.col("silhouette")).alias("silhouette"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder, whatever made them."""
    spark = df.sparkSession
    path = posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def principal_axes(units: DataFrame, vec_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes as columns) of the first ``k`` principal components.

    One pass: each task sums the vectors and their products around a fixed one
    of them (so that a mean far from zero costs no digits), Spark adds the sums
    up by row of the matrix, and the driver, which sees d x d numbers, takes the
    eigenvectors.  The largest entry of an axis is positive."""
    start = units.select(vec_col).first()
    shift = np.asarray(start[0], dtype=np.float64)
    d = len(shift)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            if b.num_rows:
                m = np.concatenate([list_matrix(b.column(0), d) - shift, np.ones((b.num_rows, 1))], axis=1)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), matrix_list(total)], names=["i", "s"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()], pa.int32()), matrix_list(list_matrix(t["s"]).sum(axis=0, keepdims=True))], names=["i", "s"])

    schema = "i int, s array<double>"
    rows = units.select(vec_col).mapInArrow(fn, schema).groupBy("i").applyInArrow(add, schema).toArrow().sort_by("i")
    sums = list_matrix(rows["s"])
    n = sums[d, d]
    off = sums[d, :d] / n
    cov = sums[:d, :d] / n - np.outer(off, off)
    axes = np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, :k]
    return shift + off, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def pca_2d(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Unit-normalize rows, centre them, project on the top 2 principal
    components (signs fixed so the largest absolute loading of each component
    is positive).  The input is evaluated once: its unit rows are written, and
    both passes read those.  One component -> y = 0.  Output: id, x, y."""
    units = written(rows.select(id_col, unit_norm(vec_col).alias("u")), "units")
    if units.isEmpty():
        return units.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mean, axes = principal_axes(units, "u", 2)
    centred = F.zip_with("u", F.lit(mean.tolist()), lambda a, b: a - b)
    on = [dot(centred, F.lit(axes[:, i].tolist())) for i in range(axes.shape[1])]
    return units.select(id_col, on[0].alias("x"), (on[1] if len(on) > 1 else F.lit(0.0)).alias("y"))


def embed_features(assignments: DataFrame, latents: DataFrame, method: str = "pca") -> DataFrame:
    """Decoder rows of the assigned features projected to 2-D, one point
    per feature (feature_index, assigned_label, specificity, mean_activation,
    x, y).  The scoring behind the assignments runs once (they are written)."""
    if method != "pca":
        raise ValueError(f"Unsupported embedding method: {method}")
    assigned = written(assignments, "assignments")
    rows = latents.join(assigned.select(F.col("feature_index").alias("latent_id")), "latent_id").select("latent_id", "w_dec")
    xy = pca_2d(rows, "latent_id", "w_dec")
    return assigned.join(xy.withColumnRenamed("latent_id", "feature_index"), "feature_index").orderBy("feature_index")


def behavior_vectors(top: DataFrame, latents: DataFrame, n: int = 8, label_col: str = "label") -> DataFrame:
    """Per label, the unit mean of the unit decoder rows of its first n
    top features.  Output: label, vector ARRAY<DOUBLE>."""
    firsts = top.filter(F.col("rank") <= n).select(label_col, "latent_id")
    rows = firsts.join(latents.select("latent_id", unit_norm("w_dec").alias("u")), "latent_id")
    per_dim = rows.select(label_col, F.posexplode("u").alias("i", "v")).groupBy(label_col, "i").agg(F.avg("v").alias("m"))
    vec = per_dim.groupBy(label_col).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    return vec.select(label_col, unit_norm(F.col("s.m")).alias("vector"))


def softmax(scores, temperature: float = 1.0) -> Column:
    """X11: softmax of an array of scores / temperature (inside the row)."""
    from tracelab.functions.vectors import per_element

    s = as_double(scores)
    t = F.lit(float(temperature))
    e = F.zip_with(s, per_element(s, F.array_max(s)), lambda v, m: F.exp((v - m) / t))
    tot = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.zip_with(e, per_element(e, tot), lambda v, z: v / z)


def top_mass_cut(probs: DataFrame, group_cols, id_col: str, prob_col: str = "p", top_p: float = 0.9) -> DataFrame:
    """Nucleus rule per group: sort by probability desc (id asc), drop an
    item when the mass before it exceeds top_p (the first is always kept),
    renormalize the kept ones."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*g).orderBy(F.col(prob_col).desc(), F.col(id_col).asc())
    before = F.coalesce(F.sum(prob_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = probs.withColumn("_before", before).filter(F.col("_before") <= top_p)
    return kept.withColumn("p_cut", F.col(prob_col) / F.sum(prob_col).over(Window.partitionBy(*g))).drop("_before")


__all__ = [
    "silhouette_cosine",
    "pca_2d",
    "embed_features",
    "behavior_vectors",
    "softmax",
    "top_mass_cut",
    "dot",
]
