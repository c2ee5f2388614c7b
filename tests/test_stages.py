"""Whole stages: labelling with resume, geometry from label records."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelab.operators.runs import label_steps
from tracelab.operators.sae import fixture_params, latents_frame, store_params
from tracelab.operators.segment import reasoning_samples
from tracelab.operators.stages import analyze_geometry, label_examples, points_of_records
from tracelab.sources.artifacts import read_geometry
from tracelab.sources.jsonl import read_step_labels


def judge_of(label):
    """A judge that names its label and the step before in the rationale."""

    def judge(pdf):
        return pd.DataFrame({"label": [label] * len(pdf), "rationale": pdf["previous_step"].fillna("first")})

    return judge


def test_label_stage_resumes_only_what_is_missing(spark, tmp_path):
    out = str(tmp_path / "records")
    rows = [(i, f"question {i}", f"step one of {i}\n\nWait, step two\n\nthree") for i in range(6)]
    examples = spark.createDataFrame(rows, "id long, question string, response string")
    first = label_examples(examples.filter("id < 2"), "id", out, "custom", judge_of("reflection"), "m1")
    assert (first.written, first.total) == (6, 6)
    again = label_examples(examples, "id", out, "custom", judge_of("other"), "m2", mode="resume")
    assert (again.written, again.recovered, again.total) == (12, 6, 18)
    got = {(r.sample_id, r.step_id): r for r in read_step_labels(spark, out).collect()}
    assert len(got) == 18 and all(r.label == ("reflection" if int(r.sample_id) < 2 else "other") for r in got.values())
    assert got["5", 0].label_rationale == "first" and got["5", 2].label_rationale == "Wait, step two"
    with pytest.raises(FileExistsError):
        label_examples(examples, "id", out)


def test_label_stage_takes_cached_responses(spark, tmp_path):
    out = str(tmp_path / "records")
    examples = spark.createDataFrame([(1, "q1", "r1"), (2, "q2", "r2")], "id long, question string, response string")
    cache = spark.createDataFrame([("2", 0, "q2", "Wait, let me verify.\n\nDone", None)], "sample_id string, seq int, question string, response string, reference_answer string")
    label_examples(examples, "id", out, responses=cache)
    assert sorted((r.sample_id, r.step_id, r.label) for r in read_step_labels(spark, out).collect()) == [("1", 0, "other"), ("2", 0, "reflection"), ("2", 1, "other")]


def test_geometry_of_label_records(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [("a", "Wait, verify that\n\nplain words here\n\nAlternatively, other"), ("b", "more plain\n\nWait"), ("b", "another text of this id\n\nx")]
    samples = spark.createDataFrame([(i, "q", t, None) for i, t in texts], "sample_id string, question string, response string, reference_answer string")
    records = label_steps(reasoning_samples(samples, "sample_id")).cache()
    points = points_of_records(records).collect()
    full = {t: f"Question:\nq\n\nResponse:\n{t}" for _, t in texts}
    for r in points:
        words = [w for i, t in texts if i == r.sample_id for w in [full[t].split()]]
        assert any(r.token_idx < len(w) for w in words)
    assert len(points) == 7 and sorted(r.step_id for r in points if r.sample_id == "b") == [0, 0, 1, 1]
    acts = [(i, k, rng.normal(size=64).tolist()) for i in ("a", "b") for k in range(12)]
    activations = spark.createDataFrame(acts, "sample_id string, token_idx long, x array<double>")
    p = fixture_params()
    out = str(tmp_path / "geometry")
    got = analyze_geometry(spark, records, activations, p, n_top=5, out=out)
    one = got.summary.first()
    assert (one.num_labeled_steps, one.num_captured_steps) == (7, 7) and -1 <= one.silhouette <= 1
    want = {r.feature_index: r.assigned_label for r in got.points.collect()}
    assert set(want.values()) <= {"reflection", "backtracking", "other"}
    summary, back = read_geometry(spark, out)
    assert {r.feature_index: r.assigned_label for r in back.collect()} == want and summary.count() == 3
    assert all(np.isclose(np.linalg.norm(r.vector), 1) for r in got.vectors.collect())
    stored = analyze_geometry(spark, records, activations, store_params(spark, p), latents_frame(spark, p), n_top=5)
    assert {r.feature_index: r.assigned_label for r in stored.points.collect()} == want
    with pytest.raises(ValueError):
        analyze_geometry(spark, records, activations, store_params(spark, p))
    few = analyze_geometry(spark, records, activations.filter(F.col("token_idx") > 100), p)
    assert few.summary.first().num_captured_steps == 0 and few.points.count() == 0
    records.unpersist()


def test_points_of_records_are_found_without_a_shuffle(spark):
    """Texts lie beside their records: nothing is grouped, whatever the order of the records."""
    texts = [("a", "Wait, one\n\ntwo words\n\nthree"), ("a", "other text of the id\n\nend"), ("c", "only step")]
    samples = spark.createDataFrame([(i, "q", t, None) for i, t in texts], "sample_id string, question string, response string, reference_answer string")
    records = label_steps(reasoning_samples(samples, "sample_id")).localCheckpoint()
    mixed = records.unionByName(records).orderBy(F.xxhash64("step_id", "full_text")).localCheckpoint()
    points = points_of_records(records)
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.sample_id, r.step_id, r.label, r.token_idx) for r in points.collect())
    # before each response are three words ("Question:", "q", "Response:")
    want = [("a", 0, 4), ("a", 0, 7), ("a", 1, 6), ("a", 1, 8), ("a", 2, 7), ("c", 0, 4)]
    assert sorted((i, s, t) for i, s, _, t in got) == want
    again = sorted((r.sample_id, r.step_id, r.label, r.token_idx) for r in points_of_records(mixed).collect())
    assert again == sorted(got + got)


def test_what_is_kept_beside_steps_is_left_out_where_nobody_reads_it(spark):
    samples = spark.createDataFrame([("a", "q", "one\n\ntwo", "r")], "sample_id string, question string, response string, reference_answer string")
    steps = reasoning_samples(samples, "sample_id")
    assert [(r.step_id, r.step_text, r.full_text[r.step_start : r.step_end], r.question) for r in steps.collect()] == [(0, "one", "one", "q"), (1, "two", "two", "q")]
    few = steps.select("sample_id", "step_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in few and "full_text" not in few.split("Generate inline")[0]
