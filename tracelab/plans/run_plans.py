"""Registered plans for labelling and run bookkeeping: judge output parsing,
judge requests, label records, resume joins, cached responses, conditions,
intervention summaries, perplexity reports."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tracelab.functions.cues import sql_cue_label
from tracelab.functions.judge import FREEFORM_LABELS, JSON_LABEL, JUDGE_USER_TEMPLATE, judge_request, judge_response_text, parse_judge_outputs
from tracelab.functions.text import NOT_WS, is_blank, py_strip, render_prompt
from tracelab.operators.runs import (
    cross_conditions,
    eval_texts,
    intervention_summary,
    label_steps,
    perplexity,
    perplexity_report,
    resume_done,
    resume_pending,
    score_runs,
    step_label_counts,
    with_cached_responses,
)
from tracelab.operators.segment import evaluate_once, reasoning_samples, segment_steps
from tracelab.plans import sqlfrag as S
from tracelab.plans.common import r6, register, table
from tracelab.plans.fixtures import DEFAULT_CONDITIONS, derived_traces
from tracelab.plans.text_plans import NL2, SQL_PAIRS, SQL_TRACE_STEPS, _qr, trace_steps
from tracelab.session import ensure_checkpoint_dir, spread
from tracelab.sources.jsonl import read_step_labels

# --- X14: judge outputs derived from the labelled trace steps ---------------


def judge_raw(steps):
    """Raw judge texts in five shapes, chosen by step_id % 5: strict JSON,
    JSON cut before its closing quote and brace, fenced block, free-form
    sentence, unusable text (blank every tenth step)."""
    js = F.to_json(F.struct(F.col("label"), F.col("step_text").alias("rationale")))
    m = F.col("step_id") % 5
    raw = (
        F.when(m == 0, js)
        .when(m == 1, F.expr("substring(to_json(named_struct('label', label, 'rationale', step_text)), 1, length(to_json(named_struct('label', label, 'rationale', step_text))) - 2)"))
        .when(m == 2, F.concat(F.lit("Here is the result:\n```json\n"), js, F.lit("\n```")))
        .when(m == 3, F.concat(F.lit("The step re-checks earlier work, so the label should be "), F.col("label"), F.lit(". It fits best.")))
        .when(F.col("step_id") % 10 == 4, F.lit(""))
        .otherwise(F.lit("no idea"))
    )
    return steps.select("doc_id", "step_id", raw.alias("raw"))


def _x14(spark, sf_dir):
    raw = judge_raw(trace_steps(spark, sf_dir))
    p = parse_judge_outputs(raw, "raw", "p")
    return p.select("doc_id", "step_id", F.col("p.label").alias("label"), F.col("p.parse_path").alias("parse_path"))


def _sql_strict_ok(v: str) -> str:
    j = f"try_cast({v} AS JSON)"
    return (
        f"(json_type({j}) = 'OBJECT' AND json_type({j}, '$.label') = 'VARCHAR' "
        f"AND lower(json_extract_string({j}, '$.label')) IN ('reflection', 'backtracking', 'other'))"
    )


def _sql_variants(c: str) -> list[str]:
    v1 = S.strip(c)
    v2 = f"replace({v1}, chr(13), '')"
    q = f"(length({v2}) - length(replace({v2}, '\"', '')))"
    fixed = f"CASE WHEN {q} % 2 = 1 THEN {v2} || '\"' ELSE {v2} END"
    fixed = f"replace(CASE WHEN NOT ends_with(regexp_replace({fixed}, '{S.WS}+$', ''), '}}') THEN regexp_replace({fixed}, '{S.WS}+$', '') || '}}' ELSE {fixed} END, chr(10), ' ')"
    v3 = f"CASE WHEN starts_with({v2}, '{{') AND contains({v2}, '\"rationale\"') THEN {fixed} END"
    return [v1, v2, v3]


def _sql_x14() -> str:
    fenced = "CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```') THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) END"
    braces = (
        "CASE WHEN instr(raw, '{') > 0 AND instr(reverse(raw), '}') > 0 AND length(raw) - instr(reverse(raw), '}') + 1 > instr(raw, '{') "
        "THEN substr(raw, instr(raw, '{'), length(raw) - instr(reverse(raw), '}') + 1 - instr(raw, '{') + 1) END"
    )
    checks = []
    for c in ("raw", fenced, braces):
        for v in _sql_variants(c):
            checks.append(f"WHEN {_sql_strict_ok(v)} THEN lower(json_extract_string(try_cast({v} AS JSON), '$.label'))")
    strict = "CASE " + " ".join(checks) + " END"
    ff_case = "CASE " + " ".join(f"WHEN regexp_matches(raw, '(?i){p}') THEN lower(regexp_extract(raw, '(?i){p}', 1))" for p in FREEFORM_LABELS) + " END"
    jl = JSON_LABEL
    return (
        SQL_TRACE_STEPS
        + f""",
lab AS (SELECT doc_id, step_id, step_text, {sql_cue_label('step_text')} AS label FROM st),
js AS (SELECT *, json_object('label', label, 'rationale', step_text)::VARCHAR AS j FROM lab),
rw AS (
  SELECT doc_id, step_id, CASE WHEN step_id % 5 = 0 THEN j
      WHEN step_id % 5 = 1 THEN substr(j, 1, length(j) - 2)
      WHEN step_id % 5 = 2 THEN 'Here is the result:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
      WHEN step_id % 5 = 3 THEN 'The step re-checks earlier work, so the label should be ' || label || '. It fits best.'
      WHEN step_id % 10 = 4 THEN '' ELSE 'no idea' END AS raw
  FROM js
),
parsed AS (
  SELECT doc_id, step_id, raw, {strict} AS strict_label,
         regexp_matches(raw, '(?i){jl}') AS jl_has, lower(regexp_extract(raw, '(?i){jl}', 1)) AS jl_label,
         {ff_case} AS ff_label
  FROM rw
),
pathed AS (
  SELECT *, CASE WHEN {S.strip('raw')} = '' THEN 'error' WHEN strict_label IS NOT NULL THEN 'json'
                 WHEN jl_has THEN 'json_like' WHEN ff_label IS NOT NULL THEN 'freeform' ELSE 'error' END AS parse_path
  FROM parsed
)
SELECT doc_id, step_id,
       CASE parse_path WHEN 'json' THEN strict_label WHEN 'json_like' THEN jl_label WHEN 'freeform' THEN ff_label END AS label,
       parse_path
FROM pathed"""
    )


register("x14_parse_judge_output", _sql_x14())(_x14)


def _x14_rat(spark, sf_dir):
    raw = judge_raw(trace_steps(spark, sf_dir))
    p = parse_judge_outputs(raw, "raw", "p")
    return p.select("doc_id", "step_id", "p.*")


# Rationales (sentence summary etc.) follow Python's Unicode regex classes;
# no RE2 oracle for them.
register("x14_judge_rationales")(_x14_rat)


# --- X15: judge HTTP responses -> text ----------------------------------------


def _x15(spark, sf_dir):
    raw = judge_raw(trace_steps(spark, sf_dir)).filter(F.col("raw") != "")
    m = F.col("step_id") % 3
    resp = (
        F.when(m == 0, F.to_json(F.struct(F.col("raw").alias("output_text"))))
        .when(
            m == 1,
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.array(
                                F.struct(F.lit("reasoning").alias("type"), F.lit("hidden").alias("text")),
                                F.struct(F.lit("output_text").alias("type"), F.col("raw").alias("text")),
                            ).alias("content")
                        )
                    ).alias("output")
                )
            ),
        )
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("raw").alias("content")).alias("message"))).alias("choices"))))
    )
    return raw.select("doc_id", "step_id", F.md5(judge_response_text(resp)).alias("text_md5"))


register(
    "x15_judge_response_text",
    _sql_x14().split("\nparsed AS")[0].rstrip(",")
    + f"""
SELECT doc_id, step_id, md5(CASE WHEN step_id % 3 = 0 THEN raw ELSE {S.strip('raw')} END) AS text_md5 FROM rw WHERE raw <> ''""",
)(_x15)


# --- E2 label records over conversation samples -------------------------------


def _e2(spark, sf_dir):
    steps = reasoning_samples(_qr(spark, sf_dir), "sample_id", "\n")
    rec = label_steps(steps, "heuristic")
    return rec.select(
        "sample_id",
        F.col("step_id").cast("long"),
        F.col("step_start_char").cast("long"),
        F.col("step_end_char").cast("long"),
        F.col("delimiter_start_char").cast("long"),
        F.col("delimiter_end_char").cast("long"),
        "label",
        "label_rationale",
        "label_source",
        F.md5("full_text").alias("full_text_md5"),
        "reference_answer",
    )


SQL_E2 = (
    "WITH "
    + SQL_PAIRS
    + """,
fulltext AS (
  SELECT sample_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10) || response AS full_text,
         length('Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10) || response) - length(response) AS rs,
         response
  FROM qr WHERE length(response) > 0
),"""
    + S.segment_cte("st", "fulltext", ["sample_id"], "full_text", "chr(10)", 1, start="rs", keep=["full_text", "response"])
    + f""",
lab AS (SELECT *, {sql_cue_label('step_text')} AS label FROM st)
SELECT sample_id::VARCHAR AS sample_id, step_id, step_start AS step_start_char, step_end AS step_end_char,
       delim_start AS delimiter_start_char, delim_end AS delimiter_end_char, label,
       CASE WHEN label = 'other' THEN 'no heuristic cue match' ELSE 'heuristic cue match' END AS label_rationale,
       'heuristic' AS label_source, md5(full_text) AS full_text_md5, {S.final_answer('response')} AS reference_answer
FROM lab"""
)

register("e2_label_steps", SQL_E2)(_e2)


def _s11(spark, sf_dir):
    """Label records written as JSON lines and loaded by their fixed schema."""
    out = posixpath.join(ensure_checkpoint_dir(spark), f"records-{uuid.uuid4().hex}")
    label_steps(reasoning_samples(_qr(spark, sf_dir), "sample_id", "\n"), "heuristic").write.json(out)
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


register("s11_step_label_records", SQL_E2)(_s11)


# --- P10 / P11 ---------------------------------------------------------------------

PROMPT_TEMPLATE = "Solve the problem below.\n{question}\nThink step by step."


def _p10(spark, sf_dir):
    q = _qr(spark, sf_dir)
    return q.select("sample_id", F.md5(render_prompt(PROMPT_TEMPLATE, "question")).alias("prompt_md5"))


register(
    "p10_render_prompt",
    "WITH "
    + SQL_PAIRS
    + f"\nSELECT sample_id, md5(replace('{PROMPT_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{question}}', {S.strip('question')})) AS prompt_md5 FROM qr",
)(_p10)


def _p11(spark, sf_dir):
    tr = derived_traces(table(spark, sf_dir, "documents"))
    st = segment_steps(tr, "response", "doc_id", "\n\n", keep=("question", "response"), with_context=True)
    req = judge_request("question", "response", "previous_step", "step_text", "next_step")
    return st.select("doc_id", "step_id", F.md5(req).alias("request_md5"), F.length(req).cast("long").alias("request_chars"))


SQL_TRACE_Q = (
    "WITH "
    + S.traces_cte()
    + ","
    + S.segment_cte("st", "traces", ["doc_id"], "response", NL2, 2, keep=["question", "response"])
)

_tpl = JUDGE_USER_TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '")

register(
    "p11_judge_requests",
    SQL_TRACE_Q
    + f""",
ctx AS (SELECT *, lag(step_text) OVER (PARTITION BY doc_id ORDER BY step_id) AS prev,
               lead(step_text) OVER (PARTITION BY doc_id ORDER BY step_id) AS nxt FROM st),
req AS (SELECT doc_id, step_id, printf('{_tpl}', question, response, coalesce(nullif(prev, ''), '<none>'), step_text,
                                       coalesce(nullif(nxt, ''), '<none>')) AS r FROM ctx)
SELECT doc_id, step_id, md5(r) AS request_md5, length(r)::BIGINT AS request_chars FROM req""",
)(_p11)


# --- J5 / J6: resume against already written label records ---------------------


def _todo_done(spark, sf_dir):
    todo = trace_steps(spark, sf_dir).select("doc_id", "step_id")
    labels = table(spark, sf_dir, "labels").filter(F.col("toxic") == 0).select("doc_id")
    done = todo.join(labels, "doc_id", "left_semi")
    return todo, done


SQL_TODO = (
    SQL_TRACE_STEPS
    + """,
done AS (SELECT doc_id, step_id FROM st WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))"""
)

register(
    "j5_resume_pending",
    SQL_TODO + "\nSELECT doc_id, step_id FROM st WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.doc_id = st.doc_id AND done.step_id = st.step_id)",
)(lambda spark, sf_dir: resume_pending(*_todo_done(spark, sf_dir), ["doc_id", "step_id"]))

register(
    "j6_resume_done",
    SQL_TODO + "\nSELECT doc_id, step_id FROM st WHERE EXISTS (SELECT 1 FROM done WHERE done.doc_id = st.doc_id AND done.step_id = st.step_id)",
)(lambda spark, sf_dir: resume_done(*_todo_done(spark, sf_dir), ["doc_id", "step_id"]))


# --- J7: cached responses ----------------------------------------------------------


def _j7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = derived_traces(docs).withColumnRenamed("doc_id", "sample_id")
    lab = table(spark, sf_dir, "labels")
    q = samples.select("sample_id", "question")
    v0 = lab.select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("seq")).join(q, "sample_id").select(
        "sample_id", "seq", "question", F.concat(F.lit("cached v0 "), F.col("sample_id").cast("string")).alias("response"), F.lit("7").alias("reference_answer")
    )
    v1 = lab.filter(F.col("quality") == 1).select(
        F.col("doc_id").alias("sample_id"),
        F.lit(1).alias("seq"),
        F.lit("").alias("question"),
        F.concat(F.lit("cached v1 "), F.col("doc_id").cast("string")).alias("response"),
        F.lit(None).cast("string").alias("reference_answer"),
    )
    out = with_cached_responses(samples.select("sample_id", "question", "response", "reference_answer"), v0.unionByName(v1), "seq")
    return out.select("sample_id", F.md5("question").alias("question_md5"), F.md5("response").alias("response_md5"), "reference_answer", "from_cache")


register(
    "j7_cached_responses",
    "WITH "
    + S.traces_cte()
    + """,
s AS (SELECT doc_id AS sample_id, question, response, reference_answer FROM traces),
cache AS (
  SELECT l.doc_id AS sample_id, 0 AS seq, s.question, 'cached v0 ' || l.doc_id::VARCHAR AS response, '7' AS reference_answer
  FROM labels l JOIN s ON s.sample_id = l.doc_id
  UNION ALL
  SELECT doc_id, 1, '', 'cached v1 ' || doc_id::VARCHAR, NULL FROM labels WHERE quality = 1
),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) AS r FROM cache) WHERE r = 1)
SELECT s.sample_id,
       md5(CASE WHEN last.sample_id IS NOT NULL AND coalesce(last.question, '') <> '' THEN last.question ELSE s.question END) AS question_md5,
       md5(CASE WHEN last.sample_id IS NOT NULL THEN last.response ELSE s.response END) AS response_md5,
       CASE WHEN last.sample_id IS NOT NULL THEN last.reference_answer ELSE s.reference_answer END AS reference_answer,
       last.sample_id IS NOT NULL AS from_cache
FROM s LEFT JOIN last ON last.sample_id = s.sample_id""",
)(_j7)


# --- J8 + A11: intervention runs -------------------------------------------------------


def derived_runs(spark, sf_dir):
    """Every trace under every condition; the vanilla run answers doc_id % 10,
    the steered ones doc_id % 9."""
    runs = cross_conditions(derived_traces(table(spark, sf_dir, "documents")), DEFAULT_CONDITIONS)
    body = F.regexp_replace("response", "\n\nFinal Answer: [0-9]+$", "")
    resp = F.when(F.col("condition") == "vanilla", F.col("response")).otherwise(
        F.concat(body, F.lit("\n\nFinal Answer: "), (F.col("doc_id") % 9).cast("string"))
    )
    return evaluate_once(runs.withColumn("response", resp))


def _runs_scored(spark, sf_dir):
    return step_label_counts(score_runs(derived_runs(spark, sf_dir)), "response", "\n\n")


def _j8(spark, sf_dir):
    r = derived_runs(spark, sf_dir)
    return r.select("doc_id", "condition", "alpha", F.md5("response").alias("response_md5"))


SQL_RUNS = (
    "WITH "
    + S.traces_cte()
    + """,
cond AS (SELECT * FROM (VALUES ('negative', 1.0::DOUBLE), ('vanilla', 0.0::DOUBLE), ('positive', -1.0::DOUBLE)) c(condition, alpha)),
runs AS (
  SELECT t.doc_id, c.condition, c.alpha, t.reference_answer,
         CASE WHEN c.condition = 'vanilla' THEN t.response
              ELSE regexp_replace(t.response, '\\n\\nFinal Answer: [0-9]+$', '') || chr(10) || chr(10) || 'Final Answer: ' || (t.doc_id % 9)::VARCHAR END AS response
  FROM traces t CROSS JOIN cond c
  WHERE regexp_matches(t.question, '""" + NOT_WS + """')
)"""
)

register("j8_cross_conditions", SQL_RUNS + "\nSELECT doc_id, condition, alpha, md5(response) AS response_md5 FROM runs")(_j8)


def _a11(spark, sf_dir):
    s = intervention_summary(_runs_scored(spark, sf_dir))
    return s.select(
        "condition",
        *[r6(c).alias(c) for c in ("mean_reflection_steps", "mean_backtracking_steps", "mean_other_steps", "accuracy")],
        F.col("num_samples").cast("long"),
        F.col("num_scored_samples").cast("long"),
    )


register(
    "a11_intervention_summary",
    SQL_RUNS
    + ","
    + S.segment_cte("st", "runs", ["doc_id", "condition"], "response", NL2, 2)
    + f""",
cnt AS (
  SELECT doc_id, condition, count_if(l = 'reflection') AS rs, count_if(l = 'backtracking') AS bs, count_if(l = 'other') AS os
  FROM (SELECT doc_id, condition, {sql_cue_label('step_text')} AS l FROM st) GROUP BY doc_id, condition
),
scored AS (SELECT r.*, {S.answer_match(S.final_answer('r.response'), 'r.reference_answer')} AS ok FROM runs r)
SELECT s.condition, round(avg(rs), 6) AS mean_reflection_steps, round(avg(bs), 6) AS mean_backtracking_steps,
       round(avg(os), 6) AS mean_other_steps, round(count_if(ok) / nullif(count(ok), 0), 6) AS accuracy,
       count(*)::BIGINT AS num_samples, count(ok)::BIGINT AS num_scored_samples
FROM scored s JOIN cnt USING (doc_id, condition) GROUP BY s.condition""",
)(_a11)


# --- A12 / A13 / P13 ----------------------------------------------------------------


def _losses(spark, sf_dir):
    """A loss for every document, with the words of its text as tokens."""
    docs = spread(table(spark, sf_dir, "documents"))
    n = F.coalesce(F.regexp_count("text", F.lit(NOT_WS + "+")), F.lit(0)).cast("long")
    loss = F.lit(2.0) + (F.col("doc_id") % 17) / 10.0
    return docs.select("source", n.alias("n_tokens"), loss.alias("loss"), (loss + (F.col("doc_id") % 5) / 100.0).alias("patched_loss"))


SQL_LOSSES = (
    "WITH "
    + S.tokens_cte("tok", "documents", ["doc_id"], "text")
    + """,
nt AS (SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id),
losses AS (SELECT d.doc_id, d.source, 2.0 + (d.doc_id % 17) / 10.0 AS loss, coalesce(nt.n_tokens, 0) AS n_tokens
           FROM documents d LEFT JOIN nt USING (doc_id)),
ppl AS (
  SELECT source,
         CASE WHEN sum(CASE WHEN n_tokens >= 2 THEN n_tokens - 1 END) > 0
              THEN exp(sum(CASE WHEN n_tokens >= 2 THEN loss * (n_tokens - 1) END) / sum(CASE WHEN n_tokens >= 2 THEN n_tokens - 1 END)) END AS p0,
         CASE WHEN sum(CASE WHEN n_tokens >= 2 THEN n_tokens - 1 END) > 0
              THEN exp(sum(CASE WHEN n_tokens >= 2 THEN (loss + (doc_id % 5) / 100.0) * (n_tokens - 1) END) / sum(CASE WHEN n_tokens >= 2 THEN n_tokens - 1 END)) END AS p1,
         coalesce(sum(CASE WHEN n_tokens >= 2 THEN n_tokens - 1 END), 0) AS n
  FROM losses GROUP BY source
)"""
)


def _a12(spark, sf_dir):
    p = perplexity(_losses(spark, sf_dir), by="source")
    return p.select("source", r6("perplexity").alias("perplexity"), "n_tokens")


register("a12_perplexity", SQL_LOSSES + "\nSELECT source, round(p0, 6) AS perplexity, n::BIGINT AS n_tokens FROM ppl")(_a12)


def _a13(spark, sf_dir):
    rep = perplexity_report(_losses(spark, sf_dir), "source")
    return rep.select(
        "source",
        r6("ppl_original").alias("ppl_original"),
        r6("ppl_with_sae").alias("ppl_with_sae"),
        r6("ppl_increase_pct").alias("ppl_increase_pct"),
        "passed",
        "all_passed",
    )


register(
    "a13_perplexity_report",
    SQL_LOSSES
    + """
SELECT source, round(p0, 6) AS ppl_original, round(p1, 6) AS ppl_with_sae, round((p1 - p0) / p0 * 100, 6) AS ppl_increase_pct,
       (p1 - p0) / p0 * 100 < 5.0 AS passed, bool_and((p1 - p0) / p0 * 100 < 5.0) OVER () AS all_passed
FROM ppl""",
)(_a13)


register(
    "p13_eval_texts",
    "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE length(text) > 50",
)(lambda spark, sf_dir: eval_texts(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id", F.length("text").cast("long").alias("n_chars")))
