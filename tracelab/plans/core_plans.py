"""Registered plans for the single operators that the composite queries use
(A7-A9, K1, K2, J4, X7, X10, D2, P1, P2, P4, P5, P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions.cues import sql_cue_label
from tracelab.functions.text import QUERY_FIELDS, SOLUTION_HEADER, first_text, normalize_text
from tracelab.functions.vectors import ends_with_tokens, sq_norm, unit_norm
from tracelab.operators.scoring import assign_features, feature_specificity, label_means, top_features
from tracelab.operators.segment import parse_general, parse_reasoning
from tracelab.operators.spans import attach_activations, mark_tokens, select_points
from tracelab.operators.stats import feature_cooccurrence
from tracelab.plans import sqlfrag as S
from tracelab.plans.common import r6, register, sql_fixture_features, table
from tracelab.plans.sae_plans import SQL_E6, fixture_features, sparse_features
from tracelab.plans.text_plans import SQL_EXAMPLES, SQL_POINTS, SQL_TRACE_STEPS, derived_examples, trace_steps
from tracelab.session import spread

_E6_CTES = SQL_E6.split("\nSELECT t.label::BIGINT")[0]


def _means(spark, sf_dir):
    params, feats = fixture_features(spark, sf_dir)
    return label_means(feats, params.d_sae)


register(
    "a7_label_means",
    _E6_CTES + "\nSELECT label::BIGINT AS label, latent_id::BIGINT AS latent_id, round(mean_activation, 6) AS mean_activation, num_steps::BIGINT AS num_steps FROM means",
)(
    lambda spark, sf_dir: _means(spark, sf_dir).select(
        F.col("label").cast("long"), "latent_id", r6("mean_activation").alias("mean_activation"), "num_steps"
    )
)

register(
    "a8_feature_specificity",
    _E6_CTES + "\nSELECT label::BIGINT AS label, latent_id::BIGINT AS latent_id, round(specificity, 6) AS specificity FROM spec",
)(
    lambda spark, sf_dir: feature_specificity(_means(spark, sf_dir)).select(
        F.col("label").cast("long"), "latent_id", r6("specificity").alias("specificity")
    )
)

register(
    "k2_top_features",
    _E6_CTES + "\nSELECT label::BIGINT AS label, rank::BIGINT AS rank, latent_id::BIGINT AS latent_id, round(specificity, 6) AS specificity FROM top",
)(
    lambda spark, sf_dir: top_features(feature_specificity(_means(spark, sf_dir)), 20).select(
        F.col("label").cast("long"), F.col("rank").cast("long"), "latent_id", r6("specificity").alias("specificity")
    )
)

register(
    "a9_assign_features",
    _E6_CTES
    + """,
asg2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY round(specificity, 9) DESC, label) AS r FROM top) WHERE r = 1)
SELECT latent_id::BIGINT AS feature_index, label::BIGINT AS assigned_label, round(specificity, 6) AS specificity,
       round(mean_activation, 6) AS mean_activation FROM asg2""",
)(
    lambda spark, sf_dir: assign_features(top_features(feature_specificity(_means(spark, sf_dir)), 20)).select(
        "feature_index",
        F.col("assigned_label").cast("long"),
        r6("specificity").alias("specificity"),
        r6("mean_activation").alias("mean_activation"),
    )
)

register(
    "k1_top_k_activate",
    "WITH " + sql_fixture_features(sparse=True) + "\nSELECT vec_id, latent_id::BIGINT AS latent_id, rnk::INT AS rank, round(v, 6) AS value FROM feats",
)(lambda spark, sf_dir: sparse_features(spark, sf_dir)[1].select("vec_id", "latent_id", "rank", r6("value").alias("value")))


def _d2(spark, sf_dir):
    _, feats = sparse_features(spark, sf_dir)
    c = feature_cooccurrence(feats, "vec_id", min_support=2)
    return c.select("latent_a", "latent_b", F.col("n_both").cast("long"), r6("jaccard").alias("jaccard"))


register(
    "d2_feature_cooccurrence",
    "WITH "
    + sql_fixture_features(sparse=True)
    + """,
act AS (SELECT vec_id, latent_id FROM feats WHERE v > 0),
n AS (SELECT latent_id, count(*) AS n FROM act GROUP BY latent_id),
pairs AS (SELECT a.latent_id AS latent_a, b.latent_id AS latent_b, count(*) AS n_both
          FROM act a JOIN act b ON a.vec_id = b.vec_id AND a.latent_id < b.latent_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT latent_a::BIGINT AS latent_a, latent_b::BIGINT AS latent_b, n_both::BIGINT AS n_both,
       round(n_both / (na.n + nb.n - n_both), 6) AS jaccard
FROM pairs JOIN n na ON na.latent_id = latent_a JOIN n nb ON nb.latent_id = latent_b""",
)(_d2)


# --- J4: labelled steps x activation rows ------------------------------------------


def _j4(spark, sf_dir):
    steps = trace_steps(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "step_id", "label", F.col("step_id").alias("token_idx"))
    acts = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("sample_id"), (F.col("vec_id") % 10).alias("token_idx"), "vec_id"
    )
    return attach_activations(steps, acts).select("sample_id", "step_id", "vec_id", "label")


register(
    "j4_attach_activations",
    SQL_TRACE_STEPS
    + f"""
SELECT st.doc_id AS sample_id, st.step_id, e.vec_id, {sql_cue_label('st.step_text')} AS label
FROM st JOIN embeddings e ON e.vec_id // 10 = st.doc_id AND e.vec_id % 10 = st.step_id""",
)(_j4)


# --- X7 / X10 ------------------------------------------------------------------------

register(
    "x7_unit_norm",
    """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))), 6) AS unit_sum,
       round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) ^ 2))), 6) AS unit_len
FROM embeddings""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "embeddings")
    .select("vec_id", unit_norm("embedding").alias("u"))
    .select("vec_id", r6(F.aggregate("u", F.lit(0.0), lambda a, v: a + v)).alias("unit_sum"), r6(F.sqrt(sq_norm("u"))).alias("unit_len"))
)


def _x10(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    seq = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s"))
    seq = seq.select("conv_id", F.col("s.n").alias("ids"))
    suffix = (
        F.when(F.col("conv_id") % 3 == 0, F.slice("ids", -1, 1))
        .when(F.col("conv_id") % 3 == 1, F.array().cast("array<bigint>"))
        .otherwise(F.concat("ids", "ids"))
    )
    return seq.select("conv_id", ends_with_tokens("ids", suffix).alias("ends_with"))


register(
    "x10_ends_with_tokens",
    """WITH s AS (SELECT conv_id, list(length(text)::BIGINT ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN len(ids) >= 1 ELSE false END AS ends_with FROM s""",
)(_x10)


# --- P1 / P2 / P4 / P5 / P14 ----------------------------------------------------------


def _conv_examples(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    g = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    first_user = conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("fu"))
    ex = g.join(first_user, "conv_id", "left").select(
        "conv_id",
        F.col("s.text").alias("question"),
        F.when(F.col("conv_id") % 4 == 0, F.lit("")).when(F.col("conv_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("fu")).alias("problem"),
    )
    return ex


def _p1(spark, sf_dir):
    ex = _conv_examples(spark, sf_dir)
    t = normalize_text(ex.schema, "question")
    return ex.select("conv_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


SQL_CONV_EX = f"""WITH g AS (
  SELECT conv_id, list(text ORDER BY turn) AS question, arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS fu
  FROM conversations GROUP BY conv_id
),
ex AS (
  SELECT conv_id, question, CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN NULL ELSE fu END AS problem,
         nullif(array_to_string(list_filter(list_transform(question, lambda t: {S.strip('t')}), lambda t: t <> ''), chr(10)), '') AS qn
  FROM g
)"""

register("p1_normalize_text", SQL_CONV_EX + "\nSELECT conv_id, md5(qn) AS text_md5, length(qn)::BIGINT AS n_chars FROM ex")(_p1)


def _p2(spark, sf_dir):
    ex = _conv_examples(spark, sf_dir)
    t = first_text(ex.schema, QUERY_FIELDS)
    return ex.select("conv_id", F.md5(t).alias("text_md5"))


register("p2_first_text", SQL_CONV_EX + "\nSELECT conv_id, md5(coalesce(nullif(problem, ''), nullif(qn, ''))) AS text_md5 FROM ex")(_p2)


def _p4(spark, sf_dir):
    parsed = parse_reasoning(derived_examples(spark, sf_dir), "doc_id", retain_query=False, delim="\n\n")
    return parsed.select("doc_id", "branch", F.md5("text").alias("text_md5"), F.inline("regions").alias("region_start", "region_end"))


register(
    "p4_reasoning_only_text",
    "WITH "
    + SQL_EXAMPLES
    + f""",
th AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1) AS inner_,
         regexp_extract(text, '(?i)({SOLUTION_HEADER})', 1) AS h
  FROM ex
),
rg AS (
  SELECT doc_id, 'think' AS branch, {S.strip('inner_[1]')} AS t FROM th WHERE len(inner_) = 1
  UNION ALL
  SELECT doc_id, 'header', {S.strip("substr(text, instr(text, h) + length(h))")} FROM th WHERE len(inner_) = 0 AND h <> ''
)
SELECT doc_id, branch, md5(t) AS text_md5, 0::BIGINT AS region_start, length(t)::BIGINT AS region_end FROM rg WHERE t <> ''""",
)(_p4)

register("p5_parse_general", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE nullif(text, '') IS NOT NULL")(
    lambda spark, sf_dir: parse_general(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id").select(
        "doc_id", F.md5("text").alias("text_md5")
    )
)


def _p14(spark, sf_dir):
    marked = mark_tokens(spread(table(spark, sf_dir, "documents")), "text", "doc_id", "\n")
    return select_points(marked).select("doc_id", "token_idx", "tok_start", "tok_end")


register(
    "p14_select_points",
    SQL_POINTS
    + """
SELECT DISTINCT t.doc_id, t.token_idx, t.tok_start, t.tok_end FROM tok t JOIN pts p ON p.doc_id = t.doc_id AND p.token_idx = t.token_idx""",
)(_p14)
