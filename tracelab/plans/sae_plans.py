"""Registered plans over ``embeddings`` with the fixture SAE (64 -> 256, k 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators.sae import fixture_params, sae_features
from tracelab.operators.scoring import behavior_summary, score_behavior
from tracelab.plans.common import SQL_FIXTURE_FEATURES, r6, register, table


def fixture_features(spark, sf_dir, sparse: bool = False):
    emb = table(spark, sf_dir, "embeddings")
    params = fixture_params(sparse=sparse)
    return params, sae_features(emb, params, "vec_id", "embedding", keep=("label",))


def _flagship(spark, sf_dir):
    params, feats = fixture_features(spark, sf_dir)
    st = score_behavior(feats, params.d_sae, n_top=20)
    out = behavior_summary(st["top"])
    return out.select(
        F.col("label").cast("long").alias("label"),
        "num_steps",
        "rank",
        "feature_index",
        r6("specificity").alias("specificity"),
        r6("mean_activation").alias("mean_activation"),
        "is_assigned",
    )


SQL_E6 = (
    "WITH "
    + SQL_FIXTURE_FEATURES
    + """,
cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
sums AS (SELECT label, latent_id, sum(v) AS s FROM feats GROUP BY label, latent_id),
means AS (
  SELECT c.label, l.latent_id, coalesce(s.s, 0) / c.n AS mean_activation, c.n AS num_steps
  FROM cnt c CROSS JOIN lat l
  LEFT JOIN sums s ON s.label = c.label AND s.latent_id = l.latent_id
),
spec AS (
  SELECT m.*, m.mean_activation - coalesce((
      SELECT max(m2.mean_activation) FROM means m2
      WHERE m2.latent_id = m.latent_id AND m2.label <> m.label), 0) AS specificity
  FROM means m
),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(specificity, 9) DESC, latent_id) AS rank
    FROM spec) WHERE rank <= 20
),
asg AS (
  SELECT latent_id, label AS assigned FROM (
    SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY round(specificity, 9) DESC, label) AS r
    FROM top) WHERE r = 1
)
SELECT t.label::BIGINT AS label, t.num_steps::BIGINT AS num_steps, t.rank::BIGINT AS rank,
       t.latent_id::BIGINT AS feature_index, round(t.specificity, 6) AS specificity,
       round(t.mean_activation, 6) AS mean_activation, coalesce(a.assigned = t.label, false) AS is_assigned
FROM top t LEFT JOIN asg a USING (latent_id)
"""
)

flagship = register("e6_score_behavior", SQL_E6)(_flagship)


# ---------------------------------------------------------------------------
# SAE statistics
# ---------------------------------------------------------------------------

from pyspark.sql import Window  # noqa: E402

from tracelab.operators.sae import sae_forward_rows  # noqa: E402
from tracelab.operators.stats import (  # noqa: E402
    argmax_index,
    batch_latents,
    batch_losses,
    browse_features,
    data_mean,
    dead_latents,
    feature_frequency,
    feature_utilization,
    latent_activity,
    max_activating,
    recon_metrics,
    unused_latents,
    utilization_histogram,
)
from tracelab.plans.common import sql_fixture_features, sql_fixture_residuals  # noqa: E402


def forward_rows(spark, sf_dir, sparse=False, budget=None):
    emb = table(spark, sf_dir, "embeddings")
    params = fixture_params(sparse=sparse)
    kw = {} if budget is None else {"budget": budget}
    return params, sae_forward_rows(emb, params, "vec_id", "embedding", keep=("label",), **kw)


def _x6_rows(rows):
    return rows.select(
        "vec_id",
        F.array_join("topk_ids", ",").alias("topk_ids"),
        r6(F.aggregate("topk_values", F.lit(0.0), lambda a, v: a + v)).alias("sum_values"),
        r6("r_sq").alias("r_sq"),
        r6("x_sq").alias("x_sq"),
        F.col("l0").cast("long").alias("l0"),
    )


SQL_X6 = (
    "WITH "
    + sql_fixture_features(sparse=True)
    + sql_fixture_residuals()
    + """,
ids AS (SELECT vec_id, string_agg(latent_id::VARCHAR, ',' ORDER BY rnk) AS topk_ids, sum(v) AS sv FROM feats GROUP BY vec_id)
SELECT r.vec_id, ids.topk_ids, round(ids.sv, 6) AS sum_values, round(r.r_sq, 6) AS r_sq, round(r.x_sq, 6) AS x_sq, l0s.l0::BIGINT AS l0
FROM rowstats r JOIN ids USING (vec_id) JOIN l0s USING (vec_id)"""
)

register("x6_sae_forward", SQL_X6)(lambda spark, sf_dir: _x6_rows(forward_rows(spark, sf_dir, sparse=True)[1]))
# Same result through the latent-block path (model over a tiny broadcast budget).
register("x5_sae_forward_blockwise", SQL_X6)(
    lambda spark, sf_dir: _x6_rows(forward_rows(spark, sf_dir, sparse=True, budget=48 * 1024)[1])
)


def _a1(spark, sf_dir):
    params, rows = forward_rows(spark, sf_dir)
    m = recon_metrics(rows, params.d_model, by="label")
    return m.select(
        F.col("label").cast("long").alias("label"),
        F.col("n_rows").cast("long").alias("n_rows"),
        *[r6(c).alias(c) for c in ("l_recon", "l2_ratio", "l0", "explained_variance")],
    )


register(
    "a1_recon_metrics",
    "WITH "
    + sql_fixture_features()
    + sql_fixture_residuals()
    + """,
ev AS (SELECT label, 1 - var_samp(r) / var_samp(x) AS explained_variance FROM res GROUP BY label)
SELECT r.label::BIGINT AS label, count(*)::BIGINT AS n_rows, round(sum(r_sq) / (count(*) * 64), 6) AS l_recon,
       round(avg(r_sq / x_sq), 6) AS l2_ratio, round(avg(l0s.l0), 6) AS l0, round(any_value(ev.explained_variance), 6) AS explained_variance
FROM rowstats r JOIN l0s USING (vec_id) JOIN ev USING (label) GROUP BY r.label""",
)(_a1)


def _a2(spark, sf_dir):
    params, rows = forward_rows(spark, sf_dir, sparse=True)
    m = recon_metrics(rows, params.d_model)
    return m.select(*[r6(c).alias(c) for c in ("l_recon", "l2_ratio", "l0", "explained_variance")])


register(
    "a2_explained_variance",
    "WITH "
    + sql_fixture_features(sparse=True)
    + sql_fixture_residuals()
    + """
SELECT round((SELECT sum(r_sq) FROM rowstats) / ((SELECT count(*) FROM rowstats) * 64), 6) AS l_recon,
       round((SELECT avg(r_sq / x_sq) FROM rowstats), 6) AS l2_ratio,
       round((SELECT avg(l0) FROM l0s), 6) AS l0,
       round((SELECT 1 - var_samp(r) / var_samp(x) FROM res), 6) AS explained_variance""",
)(_a2)


def _a3(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 128"))
    out = batch_losses(emb, fixture_params(), "batch", "embedding")
    return out.select("batch", "n_rows", "n_dead", *[r6(c).alias(c) for c in ("l_recon", "l_aux", "loss")])


register(
    "a3_aux_loss",
    "WITH "
    + sql_fixture_features()
    + sql_fixture_residuals()
    + """,
act AS (SELECT DISTINCT vec_id // 128 AS batch, latent_id FROM feats),
dz AS (SELECT z.* FROM z ANTI JOIN act ON act.batch = z.vec_id // 128 AND act.latent_id = z.latent_id),
ep AS (
  SELECT vec_id, j, sum(v * w) AS ep FROM (
    SELECT dz.vec_id, dz.v, unnest(l.wd) AS w, unnest(range(64)) AS j FROM dz JOIN latd l USING (latent_id)
  ) GROUP BY vec_id, j
),
per AS (SELECT res.vec_id // 128 AS batch, res.vec_id, res.r, coalesce(ep.ep, 0) - res.r AS d FROM res LEFT JOIN ep USING (vec_id, j)),
nd AS (SELECT batch, 256 - count(*) AS n_dead FROM act GROUP BY batch),
agg AS (
  SELECT per.batch, count(DISTINCT vec_id) AS n_rows, any_value(nd.n_dead) AS n_dead, avg(r * r) AS l_recon,
         CASE WHEN any_value(nd.n_dead) > 0 THEN avg(d * d) ELSE 0 END AS l_aux
  FROM per JOIN nd USING (batch) GROUP BY per.batch
)
SELECT batch::BIGINT AS batch, n_rows::BIGINT AS n_rows, n_dead::BIGINT AS n_dead, round(l_recon, 6) AS l_recon,
       round(l_aux, 6) AS l_aux, round(l_recon + l_aux / 32, 6) AS loss FROM agg""",
)(_a3)


def sparse_features(spark, sf_dir):
    return fixture_features(spark, sf_dir, sparse=True)


def _a4(spark, sf_dir):
    params, feats = sparse_features(spark, sf_dir)
    u = feature_utilization(feature_frequency(feats, params.d_sae), params.d_sae)
    return u.select(
        F.col("always_on").cast("long"),
        F.col("always_off").cast("long"),
        F.col("healthy").cast("long"),
        *[r6(c).alias(c) for c in ("always_on_pct", "always_off_pct", "healthy_pct")],
    )


SQL_FREQ = (
    "WITH "
    + sql_fixture_features(sparse=True)
    + """,
cnt AS (SELECT latent_id, count_if(v > 0) AS n_active FROM feats GROUP BY latent_id),
freq AS (
  SELECT l.latent_id, coalesce(c.n_active, 0) AS n_active, coalesce(c.n_active, 0) / (SELECT count(*) FROM embeddings) AS freq
  FROM lat l LEFT JOIN cnt c USING (latent_id)
)"""
)

register(
    "a4_feature_utilization",
    SQL_FREQ
    + """
SELECT count_if(freq > 0.9)::BIGINT AS always_on, count_if(freq < 0.001)::BIGINT AS always_off,
       (256 - count_if(freq > 0.9) - count_if(freq < 0.001))::BIGINT AS healthy,
       round(count_if(freq > 0.9) / 256 * 100, 6) AS always_on_pct, round(count_if(freq < 0.001) / 256 * 100, 6) AS always_off_pct,
       round((256 - count_if(freq > 0.9) - count_if(freq < 0.001)) / 256 * 100, 6) AS healthy_pct
FROM freq""",
)(_a4)


def _d3(spark, sf_dir):
    params, feats = sparse_features(spark, sf_dir)
    return utilization_histogram(feature_frequency(feats, params.d_sae), 10).select("bucket", F.col("n_latents").cast("long"))


register(
    "d3_utilization_histogram",
    SQL_FREQ + "\nSELECT least(floor(freq * 10) + 1, 10)::BIGINT AS bucket, count(*)::BIGINT AS n_latents FROM freq GROUP BY 1",
)(_d3)


def _batched_features(spark, sf_dir, size):
    _, feats = fixture_features(spark, sf_dir)
    return feats.withColumn("batch", F.expr(f"vec_id div {size}"))


def _a5(spark, sf_dir):
    return latent_activity(_batched_features(spark, sf_dir, 64), "batch", 256)


SQL_A5 = (
    "WITH "
    + sql_fixture_features()
    + """,
per AS (SELECT latent_id, count(DISTINCT vec_id // 64) AS ac, max(vec_id // 64) AS last FROM feats GROUP BY latent_id),
nb AS (SELECT max(vec_id // 64) + 1 AS nb FROM feats),
act AS (
  SELECT l.latent_id::BIGINT AS latent_id, coalesce(ac, 0)::BIGINT AS activation_count, coalesce(nb - 1 - last, nb)::BIGINT AS steps_since
  FROM lat l LEFT JOIN per USING (latent_id) CROSS JOIN nb
)"""
)

register("a5_latent_activity", SQL_A5 + "\nSELECT * FROM act")(_a5)


def _a6(spark, sf_dir):
    d = dead_latents(_a5(spark, sf_dir), threshold=3)
    return d.select(F.col("n_dead").cast("long"), r6("dead_ratio").alias("dead_ratio"), F.array_join("dead_ids", ",").alias("dead_ids"))


register(
    "a6_dead_latents",
    SQL_A5
    + """
SELECT count_if(steps_since > 3)::BIGINT AS n_dead, round(avg((steps_since > 3)::INT), 6) AS dead_ratio,
       coalesce(string_agg(CASE WHEN steps_since > 3 THEN latent_id::VARCHAR END, ',' ORDER BY latent_id), '') AS dead_ids
FROM act""",
)(_a6)


def _a14(spark, sf_dir):
    m = data_mean(table(spark, sf_dir, "embeddings"), "embedding")
    return m.select(F.posexplode("mean").alias("dim", "mean")).select(F.col("dim").cast("long"), r6("mean").alias("mean"))


register(
    "a14_data_mean",
    "WITH xe AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings)\n"
    "SELECT j::BIGINT AS dim, round(avg(x), 6) AS mean FROM xe GROUP BY j",
)(_a14)


register(
    "u2_batch_latents",
    "WITH " + sql_fixture_features() + "\nSELECT DISTINCT (vec_id // 128)::BIGINT AS batch, latent_id::BIGINT AS latent_id FROM feats",
)(lambda spark, sf_dir: batch_latents(_batched_features(spark, sf_dir, 128), "batch"))

register(
    "u3_unused_latents",
    "WITH "
    + sql_fixture_features()
    + """,
act AS (SELECT DISTINCT vec_id // 128 AS batch, latent_id FROM feats)
SELECT b.batch::BIGINT AS batch, l.latent_id::BIGINT AS latent_id
FROM (SELECT DISTINCT batch FROM act) b CROSS JOIN lat l
WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.batch = b.batch AND a.latent_id = l.latent_id)""",
)(lambda spark, sf_dir: unused_latents(_batched_features(spark, sf_dir, 128), "batch", 256))


def _k3(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    _, feats = fixture_features(spark, sf_dir)
    feats = feats.withColumn("sample", F.expr("vec_id div 10")).withColumn("position", F.col("vec_id") % 10)
    pos = emb.select(F.expr("vec_id div 10").alias("sample"), (F.col("vec_id") % 10).alias("position"))
    b = browse_features(feats, "sample", "position", pos, k=10, n_pos=5)
    return b.select(
        F.col("sample").cast("long"),
        F.col("rank").cast("long").alias("rank"),
        F.col("latent_id").alias("feature_index"),
        r6("total_activation").alias("total_activation"),
        F.col("pos_rank").cast("long"),
        F.col("position").cast("long"),
        r6("value").alias("value"),
    )


register(
    "k3_browse_features",
    "WITH "
    + sql_fixture_features()
    + """,
tot AS (SELECT vec_id // 10 AS sample, latent_id, sum(v) AS total FROM feats GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(total, 9) DESC, latent_id) AS rk FROM tot) WHERE rk <= 10),
grid AS (
  SELECT t.sample, t.latent_id, t.rk, t.total, e.vec_id % 10 AS pos, coalesce(f.v, 0) AS v
  FROM top t JOIN embeddings e ON e.vec_id // 10 = t.sample
  LEFT JOIN feats f ON f.vec_id = e.vec_id AND f.latent_id = t.latent_id
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, latent_id ORDER BY v DESC, pos) AS pr FROM grid) WHERE pr <= 5)
SELECT sample::BIGINT AS sample, rk::BIGINT AS rank, latent_id::BIGINT AS feature_index, round(total, 6) AS total_activation,
       pr::BIGINT AS pos_rank, pos::BIGINT AS position, round(v, 6) AS value
FROM best""",
)(_k3)


register(
    "k10_argmax_dimension",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax_dim FROM embeddings",
)(lambda spark, sf_dir: table(spark, sf_dir, "embeddings").select("vec_id", argmax_index("embedding").alias("argmax_dim")))


def _d1(spark, sf_dir):
    _, feats = fixture_features(spark, sf_dir)
    return max_activating(feats, "vec_id", 20).select(
        "latent_id", F.col("rank").cast("long"), "vec_id", r6("value").alias("value")
    )


register(
    "d1_max_activating_examples",
    "WITH "
    + sql_fixture_features()
    + """
SELECT latent_id::BIGINT AS latent_id, rank::BIGINT AS rank, vec_id, round(v, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY v DESC, vec_id) AS rank FROM feats WHERE v > 0
) WHERE rank <= 20""",
)(_d1)
