"""Registered plans for SAE fitting (E4 with X4 init and X12 resampling, E5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.operators.fit import metrics_frame
from tracelab.operators.sae import fixture_params, init_params_frame, latents_frame
from tracelab.operators.stats import data_mean
from tracelab.operators.table_fit import TableModel, fit_table
from tracelab.plans.common import r6, register, sql_fixture_features, sql_fixture_residuals, table


def init_from_data(spark, emb, d_sae: int = 256, k: int = 8, seed: int = 42) -> TableModel:
    """X4 + A14: Kaiming-uniform latent table built by Spark, b_dec = data mean."""
    mean = data_mean(emb, "embedding").first()["mean"]
    return TableModel.start(init_params_frame(spark, len(mean), d_sae, seed), {0: mean}, k)


def _e4(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    # one epoch over every row; the dead-latent check fires (threshold 2 steps, every 4 steps)
    log = fit_table(emb, init_from_data(spark, emb), "embedding", "vec_id", batch_size=256, lr=1e-3, warmup_steps=2,
                    dead_threshold=2, dead_check_interval=4, resample_trigger=0.1)
    rs = spark.createDataFrame([(int(m["step"]), int(m.get("resampled", 0))) for m in log], "step long, resampled long")
    mf = metrics_frame(spark, log)
    return mf.join(rs, "step").select("step", "batch", r6("loss").alias("loss"), r6("l2_ratio").alias("l2_ratio"), r6("l0").alias("l0"), "resampled")


# training: compared against numpy and finite differences in tests, rows-only here
register("e4_fit_sae")(_e4)

E5_BATCH = 128


def _e5(spark, sf_dir):
    """One epoch of every layer, all layers in the same jobs, from the fixture
    model; reported are the first step's losses, which SQL can recompute, and
    the number of steps."""
    emb = table(spark, sf_dir, "embeddings").withColumn("layer", (F.col("vec_id") % 4).cast("long"))
    start = fixture_params()
    layers = [r["layer"] for r in emb.select("layer").distinct().collect()]
    model = TableModel.start(latents_frame(spark, start), {f: start.b_dec for f in layers}, start.k)
    log = fit_table(emb, model, "embedding", "vec_id", batch_size=E5_BATCH, fit_col="layer", lr=1e-3)
    steps = {f: max(m["step"] for m in log if m["fit"] == f) for f in layers}
    rows = [(m["fit"], steps[m["fit"]], m["n_rows"], m["n_dead"], float(m["l_recon"]), float(m["l_aux"]), float(m["loss"])) for m in log if m["step"] == 1]
    out = spark.createDataFrame(rows, "layer long, steps long, n_rows long, n_dead long, l_recon double, l_aux double, loss double")
    return out.select("layer", "steps", "n_rows", "n_dead", *[r6(c).alias(c) for c in ("l_recon", "l_aux", "loss")])


register(
    "e5_fit_layers",
    "WITH "
    + sql_fixture_features()
    + sql_fixture_residuals()
    + f""",
ranked AS (SELECT vec_id, vec_id % 4 AS layer, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS i FROM embeddings),
steps AS (SELECT layer, ceil(count(*) / {E5_BATCH}.0)::BIGINT AS steps FROM ranked GROUP BY layer),
firsts AS (SELECT vec_id, layer FROM ranked WHERE i < {E5_BATCH}),
act AS (SELECT DISTINCT layer, latent_id FROM feats JOIN firsts USING (vec_id)),
dz AS (SELECT z.vec_id, z.latent_id, z.v FROM z JOIN firsts USING (vec_id) ANTI JOIN act ON act.layer = firsts.layer AND act.latent_id = z.latent_id),
ep AS (
  SELECT vec_id, j, sum(v * w) AS ep FROM (
    SELECT dz.vec_id, dz.v, unnest(l.wd) AS w, unnest(range(64)) AS j FROM dz JOIN latd l USING (latent_id)
  ) GROUP BY vec_id, j
),
per AS (SELECT layer, res.vec_id, res.r, coalesce(ep.ep, 0) - res.r AS d FROM res JOIN firsts USING (vec_id) LEFT JOIN ep USING (vec_id, j)),
nd AS (SELECT layer, 256 - count(*) AS n_dead FROM act GROUP BY layer)
SELECT layer::BIGINT AS layer, any_value(steps.steps) AS steps, count(DISTINCT vec_id)::BIGINT AS n_rows, any_value(n_dead)::BIGINT AS n_dead,
       round(avg(r * r), 6) AS l_recon, round(CASE WHEN any_value(n_dead) > 0 THEN avg(d * d) ELSE 0 END, 6) AS l_aux,
       round(avg(r * r) + CASE WHEN any_value(n_dead) > 0 THEN avg(d * d) ELSE 0 END / 32, 6) AS loss
FROM per JOIN nd USING (layer) JOIN steps USING (layer) GROUP BY layer""",
)(_e5)
