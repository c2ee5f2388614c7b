"""Behavior scoring of SAE latents: label means, specificity, top features.

All steps run on the sparse feature table ``(label, latent_id, rank, value)``
with k rows per input row.  The heavy part is a single hash aggregate on
``(label, latent_id)`` (map-side partial aggregation shrinks it to
labels x d_sae rows per task before the shuffle); everything after works on
that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order keys on computed means are rounded so that two engines that sum in a
# different order still rank identical values identically.
ORDER_DIGITS = 9


def label_means(features: DataFrame, d_sae: int, label_col: str = "label") -> DataFrame:
    """Per (label, latent) Σ value / rows with that label; absent latent = 0.

    ``features`` is the sparse top-k table; ``rank = 0`` marks exactly one
    entry per input row, so row counts per label come out of the same
    aggregate.  The grid of all latents of a label joins the sums as rows of
    zeros in one more aggregate: linear in labels x d_sae.
    Output: label, latent_id, mean_activation, num_steps.
    """
    sums = features.groupBy(label_col, "latent_id").agg(
        F.sum("value").alias("s"), F.count_if(F.col("rank") == 0).alias("c0")
    )
    per_label = sums.groupBy(label_col).agg(F.sum("c0").cast("long").alias("num_steps"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(d_sae - 1).cast("long"))
    grid = per_label.select(label_col, "num_steps", F.explode(every).alias("latent_id"))
    zeros = grid.select(F.col(label_col), "latent_id", "num_steps", F.lit(0.0).alias("s"))
    found = sums.select(F.col(label_col), "latent_id", F.lit(None).cast("long").alias("num_steps"), "s")
    both = zeros.unionByName(found).groupBy(label_col, "latent_id").agg(F.max("num_steps").alias("num_steps"), F.sum("s").alias("s"))
    return both.select(label_col, "latent_id", (F.col("s") / F.col("num_steps")).alias("mean_activation"), "num_steps")


def feature_specificity(means: DataFrame, label_col: str = "label") -> DataFrame:
    """mean(label) - max over the *other* labels' means (0 for one label).

    One window per latent ordered by mean desc: the top row subtracts the
    next one (a tie gives 0), every other row subtracts the top.
    """
    w = Window.partitionBy("latent_id").orderBy(F.col("mean_activation").desc(), F.col(label_col).asc())
    rn = F.row_number().over(w)
    top = F.first("mean_activation").over(w)
    nxt = F.lead("mean_activation", 1).over(w)
    other = F.when(rn == 1, F.coalesce(nxt, F.lit(0.0))).otherwise(top)
    return means.withColumn("specificity", F.col("mean_activation") - other)


def top_features(spec: DataFrame, n: int = 20, label_col: str = "label") -> DataFrame:
    """K2: per label the n latents with the highest specificity (rank 1..n)."""
    w = Window.partitionBy(label_col).orderBy(
        F.round("specificity", ORDER_DIGITS).desc(), F.col("latent_id").asc()
    )
    return spec.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def assign_features(top: DataFrame, label_col: str = "label") -> DataFrame:
    """Every latent in some top list goes to the label where it is most
    specific; ties go to the first label in sorted order."""
    w = Window.partitionBy("latent_id").orderBy(
        F.round("specificity", ORDER_DIGITS).desc(), F.col(label_col).asc()
    )
    return (
        top.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") == 1)
        .select(
            F.col("latent_id").alias("feature_index"),
            F.col(label_col).alias("assigned_label"),
            "specificity",
            "mean_activation",
        )
    )


def score_behavior(features: DataFrame, d_sae: int, n_top: int = 20, label_col: str = "label") -> dict:
    """E6 building blocks: returns the DataFrames of every stage."""
    means = label_means(features, d_sae, label_col)
    spec = feature_specificity(means, label_col)
    top = top_features(spec, n_top, label_col)
    assigned = assign_features(top, label_col)
    return {"means": means, "specificity": spec, "top": top, "assignments": assigned}


def behavior_summary(top: DataFrame, label_col: str = "label") -> DataFrame:
    """E6 flat summary: one row per (label, rank) with the assignment flag
    (A9 as a window over the top rows, so the top list is read once)."""
    w = Window.partitionBy("latent_id").orderBy(F.round("specificity", ORDER_DIGITS).desc(), F.col(label_col).asc())
    return top.select(
        F.col(label_col),
        F.col("num_steps"),
        F.col("rank").cast("long").alias("rank"),
        F.col("latent_id").alias("feature_index"),
        "specificity",
        "mean_activation",
        (F.first(label_col).over(w) == F.col(label_col)).alias("is_assigned"),
    )
