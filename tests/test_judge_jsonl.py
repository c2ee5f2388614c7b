"""Judge output parsing (golden strings) and resumable JSONL results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelab.functions.judge import judge_response_text, parse_judge_outputs
from tracelab.sources.jsonl import append_results, read_jsonl_tolerant, read_step_labels


def _parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    return parse_judge_outputs(df, "raw", "p").select("p.*").first()


def test_strict_json(spark):
    r = _parse(spark, '{"label":"other","rationale":"adds two numbers"}')
    assert (r.label, r.rationale, r.parse_path) == ("other", "adds two numbers", "json")


def test_truncated_json_is_repaired(spark):
    r = _parse(spark, '{"label": "other", "rationale": "Names the unknowns of the')
    assert r.label == "other" and "the unknowns" in r.rationale


def test_freeform_sentence(spark):
    raw = "Only arithmetic happens here. " 'Hence the label should be "other" in my view.'
    r = _parse(spark, raw)
    assert r.label == "other" and r.rationale and r.parse_path == "freeform"


def test_fenced_block(spark):
    r = _parse(spark, '```json\n{"label":"reflection","rationale":"looks at the sum again"}\n```')
    assert (r.label, r.rationale) == ("reflection", "looks at the sum again")


def test_json_rules_and_positions(spark):
    cases = [
        ('{"label":"other","label":"reflection"}', ("reflection", None, "json")),
        ('{"label":"Other","score":NaN}', ("other", None, "json")),
        ('{"label":"other","rationale":true}', ("other", "True", "json")),
        ('{"label":"other","rationale":"a\\ud800b"}', ("other", "a?b", "json")),
        ('{"label":"other"} and {"label":"reflection"}', ("other", None, "json_like")),
        ('{"label":7}', (None, None, "error")),
        ("[" * 5000, (None, None, "error")),
        ("\U0001f600\U0001f600 The step starts over completely. The label is backtracking, fine", ("backtracking", "\U0001f600\U0001f600 The step starts over completely.", "freeform")),
        ("\U0001f600 label: other rationale that it adds", ("other", "adds", "freeform")),
        (None, (None, None, "error")),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: (r.label, r.rationale, r.parse_path) for r in parse_judge_outputs(df, "raw", "p").select("i", "p.*").collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, (raw, got[i])


def test_unusable_output(spark):
    assert _parse(spark, "   ").parse_path == "error"
    assert _parse(spark, "no label here").label is None


def test_response_text_forms(spark):
    rows = [
        ('{"output_text": "A"}',),
        ('{"output": [{"content": [{"type": "reasoning", "text": "x"}, {"type": "output_text", "text": {"value": "B"}}]}]}',),
        ('{"choices": [{"message": {"content": [" C ", {"text": "D"}]}}]}',),
        ('{"choices": [{"message": {"content": " E "}}]}',),
    ]
    df = spark.createDataFrame(rows, "j string")
    assert [r[0] for r in df.select(judge_response_text("j")).collect()] == ["A", "B", "C\nD", "E"]


def test_resume_state_recovers_keys(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text('{"sample_id":"0","step_id":0}\n{"sample_id":"0","step_id":1}\n')
    recs, stats = read_jsonl_tolerant(spark, str(p))
    keys = {(r[0], r[1]) for r in recs.select(F.expr("variant_get(record, '$.sample_id', 'string')"), F.expr("variant_get(record, '$.step_id', 'long')")).collect()}
    assert keys == {("0", 0), ("0", 1)}
    assert stats.first().skipped_invalid_lines == 0


def test_malformed_final_line_is_skipped(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text('{"sample_id":"0","step_id":0}\n{"sample_id":"1"')
    recs, stats = read_jsonl_tolerant(spark, str(p))
    assert recs.count() == 1 and stats.first().skipped_invalid_lines == 1


def test_malformed_middle_line_raises(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text('{"a":1}\n{"broken\n{"a":2}\n')
    recs, _ = read_jsonl_tolerant(spark, str(p))
    with pytest.raises(Exception, match="line 2 of"):
        recs.count()
    p.write_text("\n\n" + '{"a":1}\n' * 2000 + "oops\n" + '{"a":2}\n' * 5)
    with pytest.raises(Exception, match="line 2003 of"):
        read_jsonl_tolerant(spark, str(p), range_bytes=100)[0].count()


def test_byte_ranges_hold_each_line_once(spark, tmp_path):
    rng = random.Random(4)
    lines = [json.dumps({"i": i, "t": "é\u2028" * rng.randint(0, 40)}, ensure_ascii=i % 2 == 0) for i in range(300)]
    lines = [x for i, line in enumerate(lines) for x in ([line, "", "  "] if i % 50 == 0 else [line])]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(lines).encode() + b'\r\n{"i": 99999, "t": "cut')
    (tmp_path / "b.jsonl").write_bytes(b"")
    (tmp_path / "_c.jsonl").write_bytes(b"hidden")
    for size in (1, 7, 64, 1000, 1 << 20):
        recs, stats = read_jsonl_tolerant(spark, str(tmp_path), range_bytes=size) if size > 7 else read_jsonl_tolerant(spark, str(tmp_path), range_bytes=size * 200)
        got = sorted(r[0] for r in recs.select(F.expr("variant_get(record, '$.i', 'int')")).collect())
        assert got == list(range(300))
        assert [r.skipped_invalid_lines for r in stats.collect()] == [1]


def test_append_modes(spark, tmp_path):
    out = str(tmp_path / "runs")
    first = spark.createDataFrame([("3", "vanilla", 0.0)], "sample_id string, condition string, alpha double")
    res = append_results(first, out, ["sample_id", "condition"], "new")
    assert res.written == 1
    with pytest.raises(FileExistsError):
        append_results(first, out, ["sample_id", "condition"], "new")
    more = spark.createDataFrame([("3", "vanilla", 0.0), ("3", "negative", 1.0)], "sample_id string, condition string, alpha double")
    res = append_results(more, out, ["sample_id", "condition"], "resume")
    assert (res.recovered, res.written, res.total) == (1, 1, 2)
    assert spark.read.json(out).count() == 2
    res = append_results(more, out, ["sample_id", "condition"], "overwrite")
    assert res.written == 2 and spark.read.json(out).count() == 2
    other = more.withColumn("step_id", F.lit(0).cast("long"))
    with pytest.raises(ValueError):
        append_results(other, out, ["sample_id", "step_id"], "resume")


def test_step_label_records_load_strictly(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"sample_id":"0","step_id":1,"label":"other","label_source":"heuristic"}\n')
    df = read_step_labels(spark, str(p))
    assert len(df.columns) == 15 and df.first().step_id == 1


def test_cached_question_clash_raises(spark):
    from tracelab.operators.runs import with_cached_responses

    samples = spark.createDataFrame([(1, "q1", "r1", "a"), (2, "q2", "r2", "b")], "sample_id long, question string, response string, reference_answer string")
    cache = spark.createDataFrame([(1, 0, "q1", "c1", "x"), (1, 1, "", "c2", None)], "sample_id long, seq int, question string, response string, reference_answer string")
    got = {r.sample_id: (r.question, r.response, r.from_cache) for r in with_cached_responses(samples, cache, "seq").collect()}
    assert got == {1: ("q1", "c2", True), 2: ("q2", "r2", False)}
    bad = spark.createDataFrame([(2, 0, "other question", "c", None)], "sample_id long, seq int, question string, response string, reference_answer string")
    with pytest.raises(Exception):
        with_cached_responses(samples, bad, "seq").collect()


def test_cut_last_line_is_per_file(spark, tmp_path):
    d = tmp_path / "runs"
    d.mkdir()
    (d / "a.jsonl").write_text('{"k":1}\n{"k":2}\n{"k":')
    (d / "b.jsonl").write_text('{"k":3}\n\n{"k"')
    recs, stats = read_jsonl_tolerant(spark, str(d))
    assert recs.count() == 3
    assert sum(r.skipped_invalid_lines for r in stats.collect()) == 2
