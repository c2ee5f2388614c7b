"""Registered plans for decoder geometry and steering."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tracelab.functions.vectors import dot, remove_projection, sq_norm
from tracelab.operators.geometry import behavior_vectors, embed_features, pca_2d, silhouette_cosine, softmax, top_mass_cut
from tracelab.operators.sae import fixture_params, latents_frame
from tracelab.operators.scoring import score_behavior
from tracelab.plans.common import ORACLE_SQL, r6, register, table
from tracelab.plans.fixtures import DEFAULT_CONDITIONS
from tracelab.plans.sae_plans import SQL_E6, fixture_features
from tracelab.session import ensure_checkpoint_dir
from tracelab.sources.artifacts import behavior_summary_records, read_geometry, write_geometry


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "label",
        (F.col("vec_id") % 4).alias("layer"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


SQL_PAIRS_2D = """
pts AS (
  SELECT vec_id AS id, label, vec_id % 4 AS layer,
         embedding[1]::DOUBLE / greatest(sqrt(embedding[1]::DOUBLE ^ 2 + embedding[2]::DOUBLE ^ 2), 1e-12) AS ux,
         embedding[2]::DOUBLE / greatest(sqrt(embedding[1]::DOUBLE ^ 2 + embedding[2]::DOUBLE ^ 2), 1e-12) AS uy
  FROM embeddings
),
pairs AS (
  SELECT p.id, p.label, p.layer, q.label AS ql, 1 - (p.ux * q.ux + p.uy * q.uy) AS d
  FROM pts p JOIN pts q ON p.id <> q.id AND p.layer = q.layer {same_group}
),
a AS (SELECT id, layer, avg(d) AS a FROM pairs WHERE ql = label GROUP BY id, layer),
bl AS (SELECT id, layer, ql, avg(d) AS m FROM pairs WHERE ql <> label GROUP BY id, layer, ql),
b AS (SELECT id, layer, min(m) AS b FROM bl GROUP BY id, layer),
sc AS (SELECT a.id, a.layer, (b.b - a.a) / greatest(a.a, b.b) AS s FROM a JOIN b USING (id, layer) WHERE greatest(a.a, b.b) > 0)"""

register(
    "a15_silhouette_cosine",
    "WITH " + SQL_PAIRS_2D.replace("AND p.layer = q.layer {same_group}", "").replace("p.layer", "0 AS layer", 1) + "\nSELECT round(avg(s), 6) AS silhouette FROM sc",
)(lambda spark, sf_dir: silhouette_cosine(_points(spark, sf_dir)).select(r6("silhouette").alias("silhouette")))

register(
    "a16_silhouette_by_layer",
    "WITH " + SQL_PAIRS_2D.format(same_group="") + "\nSELECT layer::BIGINT AS layer, round(avg(s), 6) AS silhouette FROM sc GROUP BY layer",
)(
    lambda spark, sf_dir: silhouette_cosine(_points(spark, sf_dir), by="layer").select(
        F.col("layer").cast("long"), r6("silhouette").alias("silhouette")
    )
)


def sql_axes(units: str) -> str:
    """DuckDB fragment: ``axes`` (m, v1, v2), mean and first two principal axes of
    the lists ``u`` in ``units``.  A symmetric matrix squared often enough, its
    trace kept at one, is the projector on its first axis; taken out, the same
    gives the second.  A projector's row of the largest diagonal entry is the
    axis with its largest entry positive."""

    def projector(name: str, of: str) -> str:
        trace = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i][i]))"
        scaled = "list_transform({0}, lambda r: list_transform(r, lambda x: x / {1}))"
        return f"""
{name}_pow AS (
  SELECT 0 AS n, {scaled.format('c', trace.format('c'))} AS p FROM {of}
  UNION ALL
  SELECT n + 1, {scaled.format('q', trace.format('q'))} FROM (SELECT n, list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s))) AS q FROM {name}_pow WHERE n < 24)
),
{name}_end AS (SELECT p, list_transform(range(1, len(p) + 1), lambda i: p[i][i]) AS diag FROM {name}_pow WHERE n = 24),
{name} AS (SELECT p, list_transform(p[list_position(diag, list_max(diag))], lambda x: x / sqrt(list_max(diag))) AS v FROM {name}_end)"""

    return f"""
flat AS (SELECT id, unnest(u) AS x, unnest(range(len(u))) AS i FROM {units}),
mean AS (SELECT i, avg(x) AS m FROM flat GROUP BY i),
centred AS (SELECT id, i, x - m AS x FROM flat JOIN mean USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / count(*) AS c FROM centred a JOIN centred b USING (id) GROUP BY a.i, b.i),
mat AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),{projector('one', 'mat')},
level AS (SELECT mat.c, one.p, list_dot_product(one.v, list_transform(mat.c, lambda r: list_dot_product(r, one.v))) AS e FROM mat, one),
rest AS (SELECT list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j: c[i][j] - e * p[i][j])) AS c FROM level),{projector('two', 'rest')},
axes AS (SELECT (SELECT list(m ORDER BY i) FROM mean) AS m, one.v AS v1, two.v AS v2 FROM one, two),
placed AS (
  SELECT id, list_dot_product(list_transform(range(1, len(u) + 1), lambda i: u[i] - m[i]), v1) AS x,
         list_dot_product(list_transform(range(1, len(u) + 1), lambda i: u[i] - m[i]), v2) AS y FROM {units}, axes
)"""


def _a18(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return pca_2d(e, "vec_id", "embedding").select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


register(
    "a18_pca_2d",
    """WITH RECURSIVE raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
units AS (SELECT id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM raw),"""
    + sql_axes("units")
    + "\nSELECT id AS vec_id, round(x, 6) AS x, round(y, 6) AS y FROM placed",
)(_a18)


def _stages(spark, sf_dir):
    params, feats = fixture_features(spark, sf_dir)
    return params, score_behavior(feats, params.d_sae, 20)


def _a20(spark, sf_dir):
    params, st = _stages(spark, sf_dir)
    pts = embed_features(st["assignments"], latents_frame(spark, params))
    return pts.select(
        "feature_index",
        F.col("assigned_label").cast("long").alias("assigned_label"),
        r6("specificity").alias("specificity"),
        r6("mean_activation").alias("mean_activation"),
        r6("x").alias("x"),
        r6("y").alias("y"),
    )


register(
    "a20_embed_features",
    SQL_E6.split("\nSELECT t.label::BIGINT")[0].replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
chosen AS (SELECT t.latent_id, t.label, t.specificity, t.mean_activation FROM top t JOIN asg a ON a.latent_id = t.latent_id AND a.assigned = t.label),
units AS (SELECT latent_id AS id, list_transform(wd, lambda x: x / greatest(sqrt(list_dot_product(wd, wd)), 1e-12)) AS u FROM chosen JOIN latd USING (latent_id)),"""
    + sql_axes("units")
    + """
SELECT c.latent_id::BIGINT AS feature_index, c.label::BIGINT AS assigned_label, round(c.specificity, 6) AS specificity,
       round(c.mean_activation, 6) AS mean_activation, round(p.x, 6) AS x, round(p.y, 6) AS y
FROM chosen c JOIN placed p ON p.id = c.latent_id""",
)(_a20)


def _s12(spark, sf_dir):
    """The artifacts of an analysis written and read back: the points, and how
    many top features each label's summary lists."""
    params, st = _stages(spark, sf_dir)
    out = posixpath.join(ensure_checkpoint_dir(spark), f"geometry-{uuid.uuid4().hex}")
    points = embed_features(st["assignments"], latents_frame(spark, params)).withColumn("assigned_label", F.col("assigned_label").cast("string"))
    write_geometry(behavior_summary_records(st["top"]), points, out)
    summary, back = read_geometry(spark, out)
    listed = summary.select(F.col("label").cast("string").alias("assigned_label"), "num_steps", F.size("top_features").cast("long").alias("n_top"))
    return back.join(listed, "assigned_label").select(
        "feature_index", "assigned_label", "num_steps", "n_top", r6("specificity").alias("specificity"), r6("x").alias("x"), r6("y").alias("y")
    )


register(
    "s12_geometry_artifacts",
    ORACLE_SQL["a20_embed_features"].rsplit("SELECT c.latent_id::BIGINT", 1)[0].rstrip()
    + """
SELECT c.latent_id::BIGINT AS feature_index, c.label::VARCHAR AS assigned_label, t.num_steps::BIGINT AS num_steps, t.n_top::BIGINT AS n_top,
       round(c.specificity, 6) AS specificity, round(p.x, 6) AS x, round(p.y, 6) AS y
FROM chosen c JOIN placed p ON p.id = c.latent_id
JOIN (SELECT label, any_value(num_steps) AS num_steps, count(*) AS n_top FROM top GROUP BY label) t ON t.label = c.label""",
)(_s12)


def _a19(spark, sf_dir):
    params, st = _stages(spark, sf_dir)
    bv = behavior_vectors(st["top"], latents_frame(spark, params), 8)
    return bv.select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("dim", "value")).select(
        "label", F.col("dim").cast("long"), r6("value").alias("value")
    )


_E6_CTES = SQL_E6.split("\nSELECT t.label::BIGINT")[0]
SQL_BV = (
    _E6_CTES
    + """,
firsts AS (SELECT t.label, l.wd FROM top t JOIN latd l USING (latent_id) WHERE t.rank <= 8),
dims AS (SELECT label, unnest(wd) AS v, unnest(range(64)) AS dim FROM firsts),
mean AS (SELECT label, dim, avg(v) AS m FROM dims GROUP BY label, dim),
bv AS (SELECT label, dim, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS value FROM mean)"""
)

register("a19_behavior_vectors", SQL_BV + "\nSELECT label::BIGINT AS label, dim::BIGINT AS dim, round(value, 6) AS value FROM bv")(_a19)


def _x9(spark, sf_dir):
    params, st = _stages(spark, sf_dir)
    bv = behavior_vectors(st["top"], latents_frame(spark, params), 8).filter(F.col("label") == 0).select(F.col("vector").alias("v"))
    emb = table(spark, sf_dir, "embeddings")
    conds = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(a).alias("alpha")) for n, a in
                      [(p.split(":")[0], float(p.split(":")[1])) for p in DEFAULT_CONDITIONS.split(",")]])
    # one behavior vector (label 0, d_model numbers): a constant of the plan
    vectors = bv.take(2)
    if len(vectors) > 1:
        raise ValueError("more than one behavior vector for label 0")
    one = F.array(*[F.lit(float(x)) for x in vectors[0]["v"]]) if vectors else F.lit(None).cast("array<double>")
    j = emb.select("vec_id", "embedding", one.alias("v"), F.explode(conds).alias("c")).where("v IS NOT NULL")
    h2 = remove_projection("embedding", "v", F.col("c.alpha"))
    return j.select(
        "vec_id",
        F.col("c.condition").alias("condition"),
        r6(F.sqrt(sq_norm(h2))).alias("norm"),
        r6(dot(h2, "v")).alias("dot_v"),
    )


register(
    "x9_remove_projection",
    SQL_BV
    + """,
v AS (SELECT list(value ORDER BY dim) AS v FROM bv WHERE label = 0),
cond AS (SELECT * FROM (VALUES ('negative', 1.0::DOUBLE), ('vanilla', 0.0::DOUBLE), ('positive', -1.0::DOUBLE)) c(condition, alpha)),
h AS (
  SELECT e.vec_id, c.condition, list_transform(list_zip(e.embedding::DOUBLE[], v.v),
           lambda z: z[1] - c.alpha * list_dot_product(e.embedding::DOUBLE[], v.v) * z[2]) AS h2, v.v
  FROM embeddings e CROSS JOIN cond c CROSS JOIN v
)
SELECT vec_id, condition, round(sqrt(list_dot_product(h2, h2)), 6) AS norm, round(list_dot_product(h2, v), 6) + 0.0 AS dot_v FROM h""",
)(_x9)


def _softmax_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(softmax("embedding", 0.7)).alias("dim", "p"))


register(
    "x11_softmax",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings),
e AS (SELECT vec_id, dim, exp((v - max(v) OVER (PARTITION BY vec_id)) / 0.7) AS ev FROM x)
SELECT vec_id, dim::BIGINT AS dim, round(ev / sum(ev) OVER (PARTITION BY vec_id), 6) AS p FROM e""",
)(lambda spark, sf_dir: _softmax_rows(spark, sf_dir).select("vec_id", F.col("dim").cast("long"), r6("p").alias("p")))


register(
    "w5_top_mass_cut",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings),
e AS (SELECT vec_id, dim, exp((v - max(v) OVER (PARTITION BY vec_id)) / 0.7) AS ev FROM x),
p AS (SELECT vec_id, dim, ev / sum(ev) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT vec_id, dim::BIGINT AS dim, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p_cut FROM c WHERE before <= 0.5""",
)(
    lambda spark, sf_dir: top_mass_cut(_softmax_rows(spark, sf_dir), "vec_id", "dim", "p", 0.5).select(
        "vec_id", F.col("dim").cast("long"), r6("p_cut").alias("p_cut")
    )
)
