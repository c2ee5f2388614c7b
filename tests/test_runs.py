"""Label records with a user judge, capture counts, conditions, summaries."""

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators.runs import cross_conditions, intervention_summary, label_steps, parse_conditions, perplexity
from tracelab.operators.spans import capture_counts

STEPS = "sample_id long, question string, response string, full_text string, reference_answer string, step_id long, step_start long, step_end long, delim_start long, delim_end long, step_text string"


def _steps(spark):
    rows = [
        (1, "q", "r", "f", "2", 0, 0, 5, 5, 7, "Wait, check."),
        (1, "q", "r", "f", "2", 1, 7, 12, None, None, "Done."),
        (2, "q2", "r2", "f2", None, 0, 0, 3, None, None, "Hmm"),
    ]
    return spark.createDataFrame(rows, STEPS)


def test_user_judge_sees_neighbours(spark):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = ["reflection" if (p is None or p != p) else "other" for p in pdf["previous_step"]]
        return pd.DataFrame({"label": lab, "rationale": pdf["next_step"].fillna("<none>")})

    out = {(r.sample_id, r.step_id): r for r in label_steps(_steps(spark), "custom", judge, "m1").collect()}
    assert out[("1", 0)].label == "reflection" and out[("1", 0)].label_rationale == "Done."
    assert out[("1", 1)].label == "other" and out[("1", 1)].judge_model == "m1"
    assert len(next(iter(out.values()))) == 15
    with pytest.raises(ValueError):
        label_steps(_steps(spark), "unknown")


def test_heuristic_records(spark):
    rec = {r.step_id: r for r in label_steps(_steps(spark)).filter("sample_id = '1'").collect()}
    assert rec[0].label == "reflection" and rec[0].label_source == "heuristic"
    assert rec[1].label_rationale == "no heuristic cue match"


def test_capture_counts(spark):
    steps = spark.createDataFrame([(1, 0), (1, 5), (2, 1)], "sample_id long, token_idx long")
    acts = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "sample_id long, token_idx long")
    c = capture_counts(steps, acts).first()
    assert (c.labeled, c.captured, c.missing) == (3, 2, 1)


def test_conditions_and_summary(spark):
    assert parse_conditions("negative:1.0, vanilla:0.0,positive:-1.0") == [("negative", 1.0), ("vanilla", 0.0), ("positive", -1.0)]
    with pytest.raises(ValueError):
        parse_conditions("bad")
    s = spark.createDataFrame([(1, "q"), (2, "  ")], "sample_id long, question string")
    runs = cross_conditions(s, "a:1.0,b:0.0")
    assert runs.count() == 2  # blank question removed
    r = spark.createDataFrame(
        [("a", 1, 0, 2, True), ("a", 3, 1, 0, None), ("b", 0, 0, 1, False)],
        "condition string, reflection_steps int, backtracking_steps int, other_steps int, is_correct boolean",
    )
    got = {x.condition: x for x in intervention_summary(r).collect()}
    assert got["a"].mean_reflection_steps == 2.0 and got["a"].accuracy == 1.0 and got["a"].num_scored_samples == 1
    assert got["b"].accuracy == 0.0


def test_perplexity_rules(spark):
    df = spark.createDataFrame([("s", 2.0, 3), ("s", 1.0, 1), ("t", 1.0, 1)], "src string, loss double, n_tokens long")
    got = {r.src: r.perplexity for r in perplexity(df, by="src").collect()}
    assert abs(got["s"] - 7.38905609893065) < 1e-9  # exp(2.0): the 1-token text is skipped
    assert got["t"] == float("inf")


def test_step_label_counts_in_the_row(spark):
    from tracelab.operators.runs import step_label_counts

    df = spark.createDataFrame([(1, "Wait, verify that.\n\n \n\nAlternatively, x\n\nplain\n\nWait"), (1, ""), (2, None), (3, "\u3000\n\n\x1c")], "id long, t string")
    got = sorted(tuple(r)[2:] for r in step_label_counts(df, "t", total="steps").collect())
    assert got == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (2, 1, 1, 4)]


def test_perplexity_report_of_both_losses(spark):
    from tracelab.operators.runs import perplexity_report

    df = spark.createDataFrame([("a", 2.0, 2.01, 11), ("a", 3.0, 3.02, 1), ("b", 1.0, 1.2, 5), ("c", 1.0, 1.0, 1)], "src string, loss double, patched_loss double, n_tokens long")
    got = {r.src: r for r in perplexity_report(df, "src").collect()}
    assert abs(got["a"].ppl_increase_pct - (np.exp(0.01) - 1) * 100) < 1e-9 and got["a"].passed
    assert not got["b"].passed and got["c"].ppl_original == float("inf") and not got["a"].all_passed
