"""Registered plans for the whole stages: labelling examples, analyzing geometry."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tracelab.functions.cues import sql_cue_label
from tracelab.operators.geometry import written
from tracelab.operators.runs import label_steps
from tracelab.operators.sae import fixture_params
from tracelab.operators.segment import reasoning_samples
from tracelab.operators.stages import analyze_geometry, label_examples, points_of_records
from tracelab.plans import sqlfrag as S
from tracelab.plans.common import r6, register, sql_fixture_features, table
from tracelab.plans.fixtures import conversation_pairs, derived_traces
from tracelab.plans.geometry_plans import sql_axes
from tracelab.plans.run_plans import SQL_E2
from tracelab.plans.text_plans import NL2
from tracelab.session import ensure_checkpoint_dir
from tracelab.sources.jsonl import read_step_labels


def _label_stage(spark, sf_dir):
    """Half of the examples labelled, then all resumed: the records on disk."""
    out = posixpath.join(ensure_checkpoint_dir(spark), f"stage-{uuid.uuid4().hex}")
    pairs = conversation_pairs(table(spark, sf_dir, "conversations")).select("sample_id", "question", "response")
    label_examples(pairs.filter("sample_id % 2 = 0"), "sample_id", out, delim="\n")
    label_examples(pairs, "sample_id", out, delim="\n", mode="resume")
    rec = read_step_labels(spark, out)
    return rec.select(
        "sample_id",
        *[F.col(c).cast("long") for c in ("step_id", "step_start_char", "step_end_char", "delimiter_start_char", "delimiter_end_char")],
        "label",
        "label_rationale",
        "label_source",
        F.md5("full_text").alias("full_text_md5"),
        "reference_answer",
    )


register("e2_label_stage", SQL_E2)(_label_stage)

STAGE_TOP = 12


def _geometry_stage(spark, sf_dir):
    """Labelled trace steps, a vector of ``embeddings`` for each of their tokens
    (number (7 doc_id + token) modulo the vectors), and the fixture model."""
    tr = derived_traces(table(spark, sf_dir, "documents")).withColumn("sample_id", F.col("doc_id").cast("string"))
    records = label_steps(reasoning_samples(tr.select("sample_id", "question", "response", "reference_answer"), "sample_id"))
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    points = written(points_of_records(records), "record-points")  # read twice
    at = points.filter("token_idx IS NOT NULL").select("sample_id", "token_idx")
    at = at.distinct().withColumn("vec_id", (F.col("sample_id").cast("long") * 7 + F.col("token_idx")) % n)
    x = at.join(emb.select("vec_id", F.col("embedding").alias("x")), "vec_id").select("sample_id", "token_idx", "x")
    got = analyze_geometry(spark, records, x, fixture_params(), n_top=STAGE_TOP, points=points)
    one = got.summary.first()
    return got.points.select(
        "feature_index",
        "assigned_label",
        *[r6(c).alias(c) for c in ("specificity", "mean_activation", "x", "y")],
        F.lit(one["num_labeled_steps"]).cast("long").alias("num_labeled_steps"),
        F.lit(one["num_captured_steps"]).cast("long").alias("num_captured_steps"),
        r6(F.lit(one["silhouette"]).cast("double")).alias("silhouette"),
    )


register(
    "e6_analyze_geometry",
    "WITH RECURSIVE "
    + S.traces_cte()
    + """,
fulltext AS (
  SELECT doc_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10) || response AS full_text,
         length('Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10)) AS rs
  FROM traces WHERE length(response) > 0
),"""
    + S.segment_cte("st", "fulltext", ["doc_id"], "full_text", NL2, 2, start="rs")
    + ","
    + S.tokens_cte("tok", "fulltext", ["doc_id"], "full_text")
    + """,
pd AS (SELECT s.doc_id, s.step_id, max(t.token_idx) AS ti FROM st s JOIN tok t
       ON s.doc_id = t.doc_id AND t.tok_start < s.delim_end AND t.tok_end > s.delim_start GROUP BY s.doc_id, s.step_id),
ps AS (SELECT s.doc_id, s.step_id, max(t.token_idx) AS ti FROM st s JOIN tok t
       ON s.doc_id = t.doc_id AND t.tok_start < s.step_end AND t.tok_end > s.step_start GROUP BY s.doc_id, s.step_id),"""
    + sql_fixture_features()
    + f""",
steps AS (
  SELECT s.doc_id, s.step_id, {sql_cue_label('s.step_text')} AS lab, (s.doc_id * 7 + coalesce(pd.ti, ps.ti)) % (SELECT count(*) FROM embeddings) AS vec_id
  FROM st s LEFT JOIN pd ON pd.doc_id = s.doc_id AND pd.step_id = s.step_id LEFT JOIN ps ON ps.doc_id = s.doc_id AND ps.step_id = s.step_id
),
cnt AS (SELECT lab, count(*) AS n FROM steps WHERE vec_id IS NOT NULL GROUP BY lab),
sums AS (SELECT lab, latent_id, sum(v) AS s FROM steps JOIN feats USING (vec_id) GROUP BY lab, latent_id),
means AS (SELECT c.lab, l.latent_id, coalesce(s.s, 0) / c.n AS mean_activation FROM cnt c CROSS JOIN lat l LEFT JOIN sums s ON s.lab = c.lab AND s.latent_id = l.latent_id),
spec AS (
  SELECT m.*, m.mean_activation - coalesce((SELECT max(o.mean_activation) FROM means o WHERE o.latent_id = m.latent_id AND o.lab <> m.lab), 0) AS specificity FROM means m
),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY round(specificity, 9) DESC, latent_id) AS rank FROM spec) WHERE rank <= {STAGE_TOP}),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY round(specificity, 9) DESC, lab) AS r FROM top) WHERE r = 1),
units AS (SELECT latent_id AS id, list_transform(wd, lambda x: x / greatest(sqrt(list_dot_product(wd, wd)), 1e-12)) AS u FROM chosen JOIN latd USING (latent_id)),"""
    + sql_axes("units")
    + """,
plane AS (SELECT c.latent_id, c.lab, p.x / greatest(sqrt(p.x ^ 2 + p.y ^ 2), 1e-12) AS ux, p.y / greatest(sqrt(p.x ^ 2 + p.y ^ 2), 1e-12) AS uy FROM chosen c JOIN placed p ON p.id = c.latent_id),
far AS (SELECT p.latent_id, p.lab, q.lab AS other, avg(1 - (p.ux * q.ux + p.uy * q.uy)) AS d FROM plane p JOIN plane q ON p.latent_id <> q.latent_id GROUP BY ALL),
score AS (
  SELECT (min(CASE WHEN other <> lab THEN d END) - max(CASE WHEN other = lab THEN d END)) / greatest(min(CASE WHEN other <> lab THEN d END), max(CASE WHEN other = lab THEN d END)) AS s
  FROM far GROUP BY latent_id
)
SELECT c.latent_id::BIGINT AS feature_index, c.lab AS assigned_label, round(c.specificity, 6) AS specificity, round(c.mean_activation, 6) AS mean_activation,
       round(p.x, 6) AS x, round(p.y, 6) AS y, (SELECT count(*) FROM st)::BIGINT AS num_labeled_steps, (SELECT sum(n) FROM cnt)::BIGINT AS num_captured_steps,
       round((SELECT avg(s) FROM score), 6) AS silhouette
FROM chosen c JOIN placed p ON p.id = c.latent_id""",
)(_geometry_stage)
