"""SAE statistics over features / forward rows.

Inputs are the outputs of :mod:`tracelab.operators.sae`: the sparse feature
table (k rows per input row) or the per-row forward table with squared-error
sums.  Metrics are sums over rows, so every one of them is a single hash
aggregate with map-side partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators.sae import SaeParams, StoredModel, list_matrix, model_kernels
from tracelab.session import DEFAULT_BROADCAST_BUDGET


def _variance(total: str, within: str, d_model: int) -> Column:
    """Unbiased variance over all elements of rows of ``d_model`` elements, from
    each row's sum and squared differences from its own mean: what the rows
    spread inside plus what their means spread (a built-in variance, whose
    partial results merge by their means, so a large mean costs no digits)."""
    n = F.count(F.lit(1))
    between = F.coalesce(F.var_pop(F.col(total) / d_model), F.lit(0.0)) * n * d_model
    return F.try_divide(F.sum(within) + between, n * d_model - 1)


def recon_metrics(rows: DataFrame, d_model: int, by=()) -> DataFrame:
    """A1 (+A2): l_recon = mean squared error over all elements; l2_ratio =
    mean over rows of ||x - x_hat||^2 / ||x||^2; l0 = mean count of f > 0;
    explained_variance = 1 - var(residual) / var(x), both unbiased over all
    elements flattened.  Rows with a zero vector have no ratio and are left out
    of its mean; without any variance the explained share is null."""
    by = [by] if isinstance(by, str) else list(by)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n_rows"),
        (F.sum("r_sq") / (n * d_model)).alias("l_recon"),
        F.avg(F.try_divide(F.col("r_sq"), F.col("x_sq"))).alias("l2_ratio"),
        F.avg("l0").alias("l0"),
        (F.lit(1.0) - F.try_divide(_variance("r_sum", "r_m2", d_model), _variance("x_sum", "x_m2", d_model))).alias("explained_variance"),
    ]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def feature_frequency(features: DataFrame, d_sae: int) -> DataFrame:
    """A4 part 1: per latent freq = count(f > 0) / rows, over the full grid
    (never-active latents have freq 0).  The row count comes out of the same
    aggregate (``rank = 0`` marks one entry per row) and is spread over the
    d_sae-row grid with an un-partitioned window (the grid is model-sized)."""
    spark = features.sparkSession
    per = features.groupBy("latent_id").agg(
        F.count_if(F.col("value") > 0).alias("n_active"), F.count_if(F.col("rank") == 0).alias("_first")
    )
    grid = spark.range(d_sae).withColumnRenamed("id", "latent_id")
    j = grid.join(per, "latent_id", "left")
    n_rows = F.sum(F.coalesce("_first", F.lit(0))).over(Window.partitionBy())
    return j.select(
        "latent_id",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        (F.coalesce("n_active", F.lit(0)) / n_rows).alias("freq"),
    )


def feature_utilization(freq: DataFrame, d_sae: int, on: float = 0.9, off: float = 0.001) -> DataFrame:
    """A4 part 2: always-on (> on), always-off (< off), healthy = rest, with
    percentages of d_sae."""
    a_on = F.count_if(F.col("freq") > on)
    a_off = F.count_if(F.col("freq") < off)
    return freq.agg(
        a_on.alias("always_on"),
        a_off.alias("always_off"),
        (F.lit(d_sae) - a_on - a_off).alias("healthy"),
        (a_on / F.lit(d_sae) * 100).alias("always_on_pct"),
        (a_off / F.lit(d_sae) * 100).alias("always_off_pct"),
        ((F.lit(d_sae) - a_on - a_off) / F.lit(d_sae) * 100).alias("healthy_pct"),
    )


def latent_activity(features: DataFrame, batch_col: str, d_sae: int) -> DataFrame:
    """A5: per latent, batches in which it was selected (activation_count)
    and steps since last selected (last batch - max batch; never -> number
    of batches).  Zero-valued top-k entries count as selected.  Batches are
    numbered 0..B-1; B comes from the same aggregate via a window over the
    d_sae-row grid."""
    spark = features.sparkSession
    per = features.groupBy("latent_id").agg(
        F.countDistinct(batch_col).alias("activation_count"), F.max(batch_col).alias("_last")
    )
    grid = spark.range(d_sae).withColumnRenamed("id", "latent_id")
    nb = F.max("_last").over(Window.partitionBy()) + 1
    return grid.join(per, "latent_id", "left").select(
        "latent_id",
        F.coalesce("activation_count", F.lit(0)).cast("long").alias("activation_count"),
        F.coalesce(nb - 1 - F.col("_last"), nb).cast("long").alias("steps_since"),
    )


def dead_latents(activity: DataFrame, threshold: int = 10000) -> DataFrame:
    """Latents with steps_since strictly above the threshold, and the ratio."""
    return activity.agg(
        F.count_if(F.col("steps_since") > threshold).alias("n_dead"),
        F.avg((F.col("steps_since") > threshold).cast("double")).alias("dead_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("steps_since") > threshold, F.col("latent_id")))).alias("dead_ids"),
    )


def batch_latents(features: DataFrame, batch_col: str) -> DataFrame:
    """Distinct selected latents per batch."""
    return features.select(batch_col, "latent_id").distinct()


def unused_latents(features: DataFrame, batch_col: str, d_sae: int) -> DataFrame:
    """Per batch, latents of the grid that no row of the batch selected.

    A batch's selected latents (at most d_sae) are one array, taken out of the
    grid in the row."""
    seen = features.groupBy(batch_col).agg(F.collect_set("latent_id").alias("_seen"))
    grid = F.sequence(F.lit(0).cast("long"), F.lit(d_sae - 1).cast("long"))
    return seen.select(batch_col, F.explode(F.array_except(grid, F.col("_seen").cast("array<bigint>"))).alias("latent_id"))


def data_mean(df: DataFrame, x_col: str) -> DataFrame:
    """Per-dimension mean of a vector column (one JVM aggregate)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return df.select(Summarizer.mean(array_to_vector(F.col(x_col))).alias("m")).select(vector_to_array("m").alias("mean"))


def argmax_index(col) -> Column:
    """0-based index of the highest entry of an array (first on ties)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.array_position(c, F.array_max(c)) - 1).cast("long")


def max_activating(features: DataFrame, id_col: str, n: int = 20) -> DataFrame:
    """Top n rows per latent by activation (value desc, id asc).

    ``row_number() <= n`` is planned with a partial group limit before the
    shuffle, so a latent active in a third of all rows still ships at most
    n rows per task."""
    w = Window.partitionBy("latent_id").orderBy(F.col("value").desc(), F.col(id_col).asc())
    return features.filter(F.col("value") > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def utilization_histogram(freq: DataFrame, bins: int = 10) -> DataFrame:
    """D3: latents per activation-frequency bucket: equal-width buckets
    1..bins over [0, 1], frequency 1.0 in the last bucket."""
    b = F.least(F.floor(F.col("freq") * bins) + 1, F.lit(bins))
    return freq.groupBy(b.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n_latents"))


def browse_features(features: DataFrame, sample_col: str, pos_col: str, positions: DataFrame, k: int = 10, n_pos: int = 5) -> DataFrame:
    """K3: per sample the k latents with the largest summed activation, and
    for each the n_pos positions with the highest value (zeros included,
    value desc then position asc).

    The features are read once: a window per (sample, latent) gives the
    total, a window per sample ranks the latents, and each top latent's hits
    are gathered into one row (bounded by the sample's length).  Zero-valued
    positions only matter when a latent is active at fewer than n_pos
    positions; the sample's lowest n_pos positions (from ``positions``, a
    cheap scan) always cover them and are merged inside the row.
    """
    wl = Window.partitionBy(sample_col, "latent_id")
    f = features.select(sample_col, pos_col, "latent_id", "value", F.sum("value").over(wl).alias("total_activation"))
    ws = Window.partitionBy(sample_col).orderBy(F.round("total_activation", 9).desc(), F.col("latent_id").asc())
    ranked = f.withColumn("rank", F.dense_rank().over(ws)).filter(F.col("rank") <= k)
    per = ranked.groupBy(sample_col, "latent_id").agg(
        F.first("rank").alias("rank"),
        F.first("total_activation").alias("total_activation"),
        F.collect_list(F.struct((-F.col("value")).alias("nv"), F.col(pos_col).alias("p"))).alias("hits"),
    )
    wp = Window.partitionBy(sample_col).orderBy(pos_col)
    first = (
        positions.withColumn("_r", F.row_number().over(wp))
        .filter(F.col("_r") <= n_pos)
        .groupBy(sample_col)
        .agg(F.collect_list(F.struct(F.lit(-0.0).alias("nv"), F.col(pos_col).alias("p"))).alias("zeros"))
    )
    j = per.join(first, sample_col, "left")
    hit_pos = F.transform("hits", lambda h: h["p"])
    zeros = F.filter(F.coalesce("zeros", F.array().cast("array<struct<nv:double,p:bigint>>")), lambda z: ~F.array_contains(hit_pos, z["p"]))
    best = F.slice(F.array_sort(F.concat(F.col("hits"), zeros)), 1, n_pos)
    out = j.select(sample_col, "latent_id", "rank", "total_activation", F.posexplode(best).alias("_i", "_b"))
    return out.select(
        sample_col,
        "latent_id",
        "rank",
        "total_activation",
        (F.col("_i") + 1).alias("pos_rank"),
        F.col("_b.p").alias(pos_col),
        (-F.col("_b.nv") + F.lit(0.0)).alias("value"),
    )


# ---------------------------------------------------------------------------
# A3: auxiliary loss, per batch (a batch is a bounded group of rows)
# ---------------------------------------------------------------------------

AUX_SCHEMA = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_dead", T.LongType()),
        T.StructField("l_recon", T.DoubleType()),
        T.StructField("l_aux", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
    ]
)


def batch_losses(df: DataFrame, params: SaeParams | StoredModel, batch_col: str, x_col: str, aux_weight: float = 1 / 32, budget: int = DEFAULT_BROADCAST_BUDGET) -> DataFrame:
    """A3: reconstruction + auxiliary loss of every batch.

    Latents outside the batch's top-k set ("dead" for this batch) predict
    the residual e = x - x_hat from relu(z) without b_dec; l_aux is the MSE
    over all elements (0 when every latent was selected); loss = l_recon +
    aux_weight·l_aux.  One group per batch (batch size bounds the group); the
    model is broadcast within ``budget`` bytes, a larger one streams past.
    """
    _, top_k, decode, unused = model_kernels(df.sparkSession, params, budget)
    d_sae, d_model = params.d_sae, params.d_model

    def per_batch(key: tuple, rows: pa.Table) -> pa.Table:
        x = list_matrix(rows[x_col], d_model)
        ids, vals = top_k(x)
        e = x - decode(ids, vals)
        active = np.unique(ids)
        l_recon = float(np.mean(e * e))
        l_aux = float(np.mean((unused(x, active) - e) ** 2)) if len(active) < d_sae else 0.0
        out = {"batch": [key[0].as_py()], "n_rows": [len(x)], "n_dead": [d_sae - len(active)], "l_recon": [l_recon], "l_aux": [l_aux]}
        return pa.table(out | {"loss": [l_recon + aux_weight * l_aux]})

    return df.select(F.col(batch_col).cast("long").alias(batch_col), x_col).groupBy(batch_col).applyInArrow(per_batch, AUX_SCHEMA)


def feature_cooccurrence(features: DataFrame, id_col: str, min_support: int = 1) -> DataFrame:
    """Jaccard similarity of latent activation sets (rows where f > 0).

    Pairs are formed *inside a row* from its sorted active latents (at most
    k(k+1)/2 per row, k being the model's top-k, self-pairs included to
    count each latent), never by a self-join.  One aggregate counts pairs
    (map-side partial aggregation, so a pair present in a third of all rows
    ships one partial per task); the per-latent counts are the self-pairs,
    brought to each pair by two windows over the small aggregated table, so
    the features are read once.
    Output: latent_a < latent_b, n_both, jaccard (pairs with n_both >= min_support).
    """
    act = features.filter(F.col("value") > 0)
    rows = act.groupBy(id_col).agg(F.array_sort(F.collect_list("latent_id")).alias("ids"))
    n = F.size("ids")
    pairs = rows.select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda i: F.transform(
                        F.slice("ids", i + 1, n - i),
                        lambda b: F.struct(F.element_at("ids", i + 1).alias("a"), b.alias("b")),
                    ),
                )
            )
        ).alias("p")
    ).select(F.col("p.a").alias("latent_a"), F.col("p.b").alias("latent_b"))
    counts = pairs.groupBy("latent_a", "latent_b").agg(F.count(F.lit(1)).alias("n_both"))
    self_n = F.when(F.col("latent_a") == F.col("latent_b"), F.col("n_both"))
    with_n = counts.select(
        "latent_a",
        "latent_b",
        "n_both",
        F.max(self_n).over(Window.partitionBy("latent_a")).alias("n_a"),
        F.max(self_n).over(Window.partitionBy("latent_b")).alias("n_b"),
    )
    return with_n.filter((F.col("latent_a") < F.col("latent_b")) & (F.col("n_both") >= min_support)).select(
        "latent_a", "latent_b", "n_both", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard")
    )
