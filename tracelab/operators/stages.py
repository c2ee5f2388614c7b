"""Whole stages over tables: label the steps of examples, and analyze the
geometry of the latents that go with the labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelab.operators.geometry import behavior_vectors, embed_features, silhouette_cosine, written
from tracelab.operators.runs import label_steps, with_cached_responses
from tracelab.operators.sae import SaeParams, StoredModel, latents_frame, sae_features
from tracelab.operators.scoring import assign_features, score_behavior
from tracelab.operators.segment import extract_question_response, reasoning_samples, word_spans
from tracelab.operators.spans import Spans, attach_activations, point_finder
from tracelab.sources.artifacts import behavior_summary_records, write_geometry
from tracelab.sources.jsonl import AppendResult, append_results, read_step_labels, recovered


def label_examples(
    examples: DataFrame,
    id_col: str,
    out: str,
    judge: str = "heuristic",
    judge_fn=None,
    judge_model: str | None = None,
    delim: str = "\n\n",
    mode: str = "new",
    responses: DataFrame | None = None,
    response_order: str = "seq",
    parsed: bool = False,
) -> AppendResult:
    """The label-steps stage: question and response of every example (P6, or
    ``parsed`` columns question, response, reference_answer), cached responses
    over them (J7), steps (X1, P16), labels (E2), appended to the JSON lines at
    ``out`` (S10; ``mode`` new, resume or overwrite).  On resume only steps
    without a record are given to the judge (J5)."""
    samples = examples.select(F.col(id_col), "question", "response", "reference_answer") if parsed else extract_question_response(examples, id_col)
    samples = samples.withColumn("sample_id", F.col(id_col).cast("string")).select("sample_id", "question", "response", "reference_answer")
    if responses is not None:
        samples = with_cached_responses(samples, responses, response_order).drop("from_cache")
    steps = reasoning_samples(samples, "sample_id", delim, with_context=judge_fn is not None)
    keys = {"sample_id": "string", "step_id": "int"}
    if mode == "resume" and (done := recovered(examples.sparkSession, out, keys)) is not None:
        steps = steps.withColumn("_step", F.col("step_id").cast("int")).join(done.withColumnRenamed("step_id", "_step"), ["sample_id", "_step"], "left_anti").drop("_step")
    return append_results(label_steps(steps, judge, judge_fn, judge_model), out, list(keys), mode)


def points_of_records(records: DataFrame, spans: Spans = word_spans, max_len: int | None = None) -> DataFrame:
    """J1 + J2 for label records: the token of every labelled step.  Every
    record has its text beside it, so its point is found in the row and no text
    is shuffled; records of one text that follow each other, as they are made
    and stored, share its tokens.  Output: sample_id, step_id, label, token_idx."""
    at = [F.col(c).cast("long") for c in ("step_start_char", "step_end_char", "delimiter_start_char", "delimiter_end_char")]
    staged = records.filter(F.col("full_text").isNotNull()).select("sample_id", F.col("step_id").cast("long").alias("step_id"), "label", "full_text", *at)
    schema = StructType([*staged.schema.fields[:3], StructField("token_idx", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, find = None, None
        for b in batches:
            points = []
            for given, *step in zip(b.column(3), *(b.column(i).to_pylist() for i in range(4, 8)), strict=True):
                if text is None or not text.equals(given.as_buffer()):
                    text = pa.py_buffer(given.as_buffer().to_pybytes())  # (a copy: the batch is not held)
                    find = point_finder(list(islice(spans(given.as_py()), max_len)))
                points.append(find(*step))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(points, pa.int64())], names=schema.names)

    return staged.mapInArrow(run, schema)


@dataclass
class Geometry:
    """What ``analyze_geometry`` found: one row of ``summary``; by label the
    ``top`` features and ``vectors``; by feature the ``points``."""

    summary: DataFrame
    top: DataFrame
    points: DataFrame
    vectors: DataFrame


def analyze_geometry(
    spark: SparkSession,
    labels: str | DataFrame,
    activations: DataFrame,
    model: SaeParams | StoredModel,
    latents: DataFrame | None = None,
    n_top: int = 20,
    n_vector: int = 8,
    spans: Spans = word_spans,
    out: str | None = None,
    points: DataFrame | None = None,
) -> Geometry:
    """The analyze-geometry stage: label records (S11, a path or a DataFrame),
    their tokens (J1, J2), the activations there (J4: sample_id, token_idx, x),
    top features of the model (X6), label means, specificity and assignments
    (A7-A9, K2), the assigned decoder rows in the plane (A18, A20) with their
    silhouette (A15), and behavior vectors (A19).  With ``out`` summary and
    points are written there (S12).  ``latents`` is the model's table where it
    is not in memory, ``points`` are the records' tokens where they are known."""
    records = read_step_labels(spark, labels) if isinstance(labels, str) else labels
    places = points_of_records(records, spans) if points is None else points
    steps = attach_activations(places, activations.select(F.col("sample_id").cast("string"), "token_idx", "x"))
    steps = steps.withColumn("step", F.concat_ws("/", "sample_id", F.col("step_id").cast("string")))
    feats = sae_features(steps, model, "step", "x", keep=("label",))
    top = written(score_behavior(feats, model.d_sae, n_top)["top"], "top")  # all that follows reads these few rows
    if latents is None:
        if not isinstance(model, SaeParams):
            raise ValueError("give the latents table of a stored model")
        latents = latents_frame(spark, model)
    placed = embed_features(assign_features(top), latents)
    counts = records.agg(F.count(F.lit(1)).alias("num_labeled_steps"))
    captured = top.select("label", "num_steps").distinct().agg(F.coalesce(F.sum("num_steps"), F.lit(0)).alias("num_captured_steps"))
    silhouette = silhouette_cosine(placed, "assigned_label")
    # three one-row tables side by side
    summary = counts.crossJoin(F.broadcast(captured)).join(F.broadcast(silhouette), F.lit(True), "left").withColumn("embedding_method", F.lit("pca"))
    if out is not None:
        write_geometry(behavior_summary_records(top), placed, out)
    return Geometry(summary, top, placed, behavior_vectors(top, latents, n_vector))
