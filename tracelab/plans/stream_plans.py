"""Registered plans that run Structured Streaming pipelines over the driver
tables (each table file is consumed as a file stream) and return the sink."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tracelab.operators.sae import fixture_params, sae_features, sae_forward_rows
from tracelab.operators.segment import segment_steps
from tracelab.plans.common import r6, register, sql_fixture_features, sql_fixture_residuals, table
from tracelab.plans.fixtures import derived_traces
from tracelab.plans.sae_plans import SQL_A5
from tracelab.plans.text_plans import SQL_TRACE_STEPS
from tracelab.functions.cues import sql_cue_label
from tracelab.plans import sqlfrag as S
from tracelab.session import ensure_checkpoint_dir
from tracelab.streaming.streams import (
    latest_activity,
    run_to_table,
    running_best,
    stream_files,
    stream_label_steps,
    stream_latent_activity,
    stream_recon_metrics,
    stream_segment,
)


def _stream(spark, sf_dir, name, max_files_per_trigger=1):
    """The table as a stream: a single file by its name in ``sf_dir``, or all
    part files of a folder."""
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream_files(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema, "parquet", max_files_per_trigger=max_files_per_trigger)
    return stream_files(spark, sf_dir, schema, "parquet", file_glob=f"{name}.parquet")


def _out(spark, name):
    return posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


register("t1_stream_activations", "SELECT vec_id, label::BIGINT AS label FROM embeddings")(
    lambda spark, sf_dir: run_to_table(_stream(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long")), "t1", "append")
)


def _t2(spark, sf_dir):
    s = _stream(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 64"))
    feats = sae_features(s, fixture_params(), "vec_id", "embedding", keep=("batch",))
    upd = run_to_table(stream_latent_activity(feats, "batch"), "t2", "update")
    return latest_activity(upd, 256)


register("t2_stream_latent_activity", SQL_A5 + "\nSELECT * FROM act")(_t2)


def _t3(spark, sf_dir):
    out = stream_segment(_stream(spark, sf_dir, "documents"), _out(spark, "t3"), "text", "doc_id", "\n")
    return spark.read.parquet(out).drop("batch_id")


register(
    "t3_stream_segment",
    "WITH " + S.segment_cte("st", "documents", ["doc_id"], "text", "chr(10)", 1) + "\nSELECT doc_id, step_id, step_start, step_end, delim_start, delim_end FROM st",
)(_t3)


def _t4(spark, sf_dir):
    def prepare(df):
        return segment_steps(derived_traces(df), "response", "doc_id", "\n\n")

    out = stream_label_steps(_stream(spark, sf_dir, "documents"), _out(spark, "t4"), ["doc_id", "step_id"], prepare)
    return spark.read.parquet(out).select("doc_id", "step_id", "step_start", "step_end", "delim_start", "delim_end", "label")


register(
    "t4_stream_label_steps",
    SQL_TRACE_STEPS + f"\nSELECT doc_id, step_id, step_start, step_end, delim_start, delim_end, {sql_cue_label('step_text')} AS label FROM st",
)(_t4)


T5_PARTS = 4


def _t5(spark, sf_dir):
    """The table in parts that arrive one after the other; the stream resumes
    after each, which makes a micro-batch."""
    params = fixture_params()
    emb = table(spark, sf_dir, "embeddings")
    parts, out = _out(spark, "t5-parts"), _out(spark, "t5")
    for i in range(T5_PARTS):
        emb.filter(F.col("vec_id") % T5_PARTS == i).write.mode("append").parquet(parts)
        stream = stream_files(spark, parts, emb.schema, "parquet", max_files_per_trigger=None)
        stream_recon_metrics(sae_forward_rows(stream, params, "vec_id", "embedding"), out, params.d_model)
    m = running_best(spark.read.parquet(out).drop("batch_id"), "l2_ratio")
    return m.select(
        "micro_batch",
        F.col("n_rows").cast("long"),
        *[r6(c).alias(c) for c in ("l_recon", "l2_ratio", "l0", "explained_variance", "best_l2_ratio")],
    )


register(
    "t5_stream_recon_metrics",
    "WITH "
    + sql_fixture_features()
    + sql_fixture_residuals()
    + f""",
ev AS (SELECT vec_id % {T5_PARTS} AS part, 1 - var_samp(r) / var_samp(x) AS ev FROM res GROUP BY 1),
per AS (
  SELECT vec_id % {T5_PARTS} AS part, count(*) AS n, sum(r_sq) / (count(*) * 64) AS l_recon, avg(r_sq / x_sq) AS l2, avg(l0s.l0) AS l0
  FROM rowstats JOIN l0s USING (vec_id) GROUP BY 1
)
SELECT part::BIGINT AS micro_batch, n::BIGINT AS n_rows, round(l_recon, 6) AS l_recon, round(l2, 6) AS l2_ratio, round(l0, 6) AS l0,
       round(ev, 6) AS explained_variance,
       round(min(l2) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_l2_ratio
FROM per JOIN ev USING (part)""",
)(_t5)
