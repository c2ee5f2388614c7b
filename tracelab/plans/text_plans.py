"""Registered plans over ``documents`` / ``conversations``: segmentation,
tokens, activation points, cue labels, answers, reasoning parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelab.functions.cues import cue_label, sql_cue_label
from tracelab.functions.text import SOLUTION_HEADER, answer_match, extract_final_answer, normalize_answer
from tracelab.operators.segment import (
    evaluate_once,
    extract_question_response,
    parse_reasoning,
    reasoning_examples,
    reasoning_samples,
    segment_regions,
    segment_steps,
    tokenize_words,
)
from tracelab.operators.runs import STEP_COUNTS, step_label_counts
from tracelab.operators.spans import activation_points, keep_usable, point_masks
from tracelab.plans import sqlfrag as S
from tracelab.plans.common import ORACLE_SQL, register, table
from tracelab.plans.fixtures import conversation_pairs, derived_traces
from tracelab.session import spread

NL = "chr(10)"
NL2 = "chr(10) || chr(10)"
STEP_OUT = ["step_id", "step_start", "step_end", "delim_start", "delim_end"]


# --- X1 on documents (delimiter = newline) ---------------------------------


def _doc_steps(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return segment_steps(docs, "text", "doc_id", "\n", with_text=False)


register(
    "x1_segment_documents",
    "WITH "
    + S.segment_cte("st", "documents", ["doc_id"], "text", NL, 1)
    + "\nSELECT doc_id, step_id, step_start, step_end, delim_start, delim_end FROM st",
)(_doc_steps)


# --- X1 + X13 on the derived traces ----------------------------------------


def trace_steps(spark, sf_dir):
    tr = derived_traces(table(spark, sf_dir, "documents"))
    st = segment_steps(tr, "response", "doc_id", "\n\n")
    return st.withColumn("label", cue_label("step_text"))


def _trace_labels(spark, sf_dir):
    return trace_steps(spark, sf_dir).select("doc_id", *STEP_OUT, "label")


SQL_TRACE_STEPS = "WITH " + S.traces_cte() + "," + S.segment_cte("st", "traces", ["doc_id"], "response", NL2, 2)

register(
    "x13_trace_step_labels",
    SQL_TRACE_STEPS + f"\nSELECT doc_id, step_id, step_start, step_end, delim_start, delim_end, {sql_cue_label('step_text')} AS label FROM st",
)(_trace_labels)


def _label_counts(spark, sf_dir):
    tr = derived_traces(table(spark, sf_dir, "documents"))
    return step_label_counts(tr, "response", "\n\n").select("doc_id", *STEP_COUNTS)


register(
    "a10_step_label_counts",
    SQL_TRACE_STEPS
    + f""",
lab AS (SELECT doc_id, {sql_cue_label('step_text')} AS label FROM st)
SELECT doc_id, count_if(label = 'reflection')::BIGINT AS reflection_steps,
       count_if(label = 'backtracking')::BIGINT AS backtracking_steps,
       count_if(label = 'other')::BIGINT AS other_steps
FROM lab GROUP BY doc_id""",
)(_label_counts)


# --- P7 / P8 / P9 -------------------------------------------------------------


def _answers(spark, sf_dir):
    tr = derived_traces(table(spark, sf_dir, "documents"), keep=("text",))
    # each answer is extracted once; normalising / matching read the result
    ans = evaluate_once(
        tr.select(
            "doc_id",
            "reference_answer",
            extract_final_answer("response").alias("predicted_answer"),
            extract_final_answer("text").alias("last_line_answer"),
        )
    )
    return ans.select(
        "doc_id",
        "predicted_answer",
        "last_line_answer",
        normalize_answer("last_line_answer").alias("normalized_last_line"),
        answer_match("predicted_answer", "reference_answer").alias("is_correct"),
        answer_match(F.lit(" 5 "), "reference_answer").alias("is_five"),
    )


register(
    "p7_final_answers",
    "WITH "
    + S.traces_cte()
    + f"""
SELECT t.doc_id, {S.final_answer('t.response')} AS predicted_answer,
       {S.final_answer('t.text')} AS last_line_answer,
       {S.normalize_answer(S.final_answer('t.text'))} AS normalized_last_line,
       {S.answer_match(S.final_answer('t.response'), 't.reference_answer')} AS is_correct,
       {S.answer_match("' 5 '", 't.reference_answer')} AS is_five
FROM traces t""",
)(_answers)


# --- X2 / J1-J3 / P12 ---------------------------------------------------------


def _token_stats(spark, sf_dir):
    tok = tokenize_words(spread(table(spark, sf_dir, "documents")), "text", "doc_id")
    return tok.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum("tok_start").alias("sum_start"),
        F.max("tok_end").alias("max_end"),
        F.sum(F.length("token")).cast("long").alias("token_chars"),
    )


SQL_TOKENS = "WITH " + S.tokens_cte("tok", "documents", ["doc_id"], "text")

register(
    "x2_token_offsets",
    SQL_TOKENS
    + """
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(tok_start)::BIGINT AS sum_start, max(tok_end)::BIGINT AS max_end,
       sum(length(token))::BIGINT AS token_chars
FROM tok GROUP BY doc_id""",
)(_token_stats)


SQL_POINTS = (
    SQL_TOKENS
    + ","
    + S.segment_cte("st", "documents", ["doc_id"], "text", NL, 1)
    + """,
pd AS (SELECT s.doc_id, s.step_id, max(t.token_idx) AS ti FROM st s JOIN tok t
       ON s.doc_id = t.doc_id AND t.tok_start < s.delim_end AND t.tok_end > s.delim_start GROUP BY s.doc_id, s.step_id),
ps AS (SELECT s.doc_id, s.step_id, max(t.token_idx) AS ti FROM st s JOIN tok t
       ON s.doc_id = t.doc_id AND t.tok_start < s.step_end AND t.tok_end > s.step_start GROUP BY s.doc_id, s.step_id),
pts AS (SELECT s.doc_id, s.step_id, coalesce(pd.ti, ps.ti)::BIGINT AS token_idx FROM st s
        LEFT JOIN pd ON pd.doc_id = s.doc_id AND pd.step_id = s.step_id
        LEFT JOIN ps ON ps.doc_id = s.doc_id AND ps.step_id = s.step_id)"""
)

register("j2_activation_points", SQL_POINTS + "\nSELECT doc_id, step_id, token_idx FROM pts")(
    lambda spark, sf_dir: activation_points(spread(table(spark, sf_dir, "documents")), "text", "doc_id", "\n")
)


def doc_masks(spark, sf_dir):
    return point_masks(spread(table(spark, sf_dir, "documents")), "text", "doc_id", "\n")


def _point_mask(spark, sf_dir):
    m = doc_masks(spark, sf_dir).filter(F.size("points") > 0)
    return m.select("doc_id", F.size("points").cast("long").alias("n_points"), F.array_join("points", ",").alias("points"))


register(
    "j3_point_mask",
    SQL_POINTS
    + """
SELECT doc_id, count(DISTINCT token_idx)::BIGINT AS n_points,
       array_to_string(list_sort(list_distinct(list(token_idx))), ',') AS points
FROM pts WHERE token_idx IS NOT NULL GROUP BY doc_id""",
)(_point_mask)


def _usable(spark, sf_dir):
    return keep_usable(doc_masks(spark, sf_dir), 10).select("doc_id", "n_tokens", F.size("points").cast("long").alias("n_points"))


register(
    "p12_keep_usable",
    SQL_POINTS
    + f""",
nt AS (SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id),
np AS (SELECT doc_id, count(DISTINCT token_idx) AS n_points FROM pts WHERE token_idx IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, nt.n_tokens::BIGINT AS n_tokens, np.n_points::BIGINT AS n_points
FROM documents d JOIN nt USING (doc_id) JOIN np USING (doc_id)
WHERE regexp_matches(d.text, '{S.NOT_WS}') AND nt.n_tokens >= 10 AND np.n_points > 0""",
)(_usable)


# --- W1 step context + P11 judge requests ----------------------------------


def _context(spark, sf_dir):
    tr = derived_traces(table(spark, sf_dir, "documents"))
    st = segment_steps(tr, "response", "doc_id", "\n\n", with_text=False, with_context=True)
    return st.select(
        "doc_id",
        "step_id",
        F.md5(F.coalesce("previous_step", F.lit("<none>"))).alias("previous_md5"),
        F.md5(F.coalesce("next_step", F.lit("<none>"))).alias("next_md5"),
    )


register(
    "w1_step_context",
    SQL_TRACE_STEPS
    + """
SELECT doc_id, step_id,
       md5(coalesce(lag(step_text) OVER (PARTITION BY doc_id ORDER BY step_id), '<none>')) AS previous_md5,
       md5(coalesce(lead(step_text) OVER (PARTITION BY doc_id ORDER BY step_id), '<none>')) AS next_md5
FROM st""",
)(_context)


def _ordered_steps(spark, sf_dir):
    """Steps of a sample ordered by step_id (as one ordered label string)."""
    st = trace_steps(spark, sf_dir)
    g = st.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("step_id", "label"))).alias("s"))
    return g.select("doc_id", F.array_join(F.col("s.label"), ",").alias("label_sequence"))


register(
    "w2_order_steps",
    SQL_TRACE_STEPS
    + f"""
SELECT doc_id, string_agg({sql_cue_label('step_text')}, ',' ORDER BY step_id) AS label_sequence FROM st GROUP BY doc_id""",
)(_ordered_steps)


# --- P6 / P16 on conversations ---------------------------------------------


def _qr(spark, sf_dir):
    pairs = conversation_pairs(table(spark, sf_dir, "conversations"))
    return extract_question_response(pairs.select("sample_id", "question", "response"), "sample_id")


def _p6(spark, sf_dir):
    return _qr(spark, sf_dir).select(
        "sample_id", F.length("question").cast("long").alias("question_chars"), F.md5("response").alias("response_md5"), "reference_answer"
    )


SQL_PAIRS = """
pairs AS (
  SELECT conv_id * 1000 + turn AS sample_id, text AS question, nt AS response FROM (
    SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
    FROM conversations) WHERE role = 'user' AND nr = 'assistant'
),
hdr AS (
  SELECT *, regexp_extract(response, '(?i)(""" + SOLUTION_HEADER + """)', 1) AS h FROM pairs
),
qr AS (
  SELECT sample_id,
         question,
         CASE WHEN h <> '' AND """ + S.strip("substr(response, instr(response, h) + length(h))") + """ <> ''
              THEN """ + S.strip("substr(response, instr(response, h) + length(h))") + """
              ELSE response END AS response
  FROM hdr WHERE question IS NOT NULL AND question <> ''
)"""

register(
    "p6_question_response",
    "WITH "
    + SQL_PAIRS
    + f"""
SELECT sample_id, length(question)::BIGINT AS question_chars, md5(response) AS response_md5,
       {S.final_answer('response')} AS reference_answer
FROM qr""",
)(_p6)


def _p16(spark, sf_dir):
    st = reasoning_samples(_qr(spark, sf_dir), "sample_id", "\n")
    return st.select("sample_id", *STEP_OUT, F.col("response_start_char").cast("long").alias("response_start_char"))


register(
    "p16_reasoning_samples",
    "WITH "
    + SQL_PAIRS
    + """,
fulltext AS (
  SELECT sample_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10) || response AS full_text,
         length('Question:' || chr(10) || question || chr(10) || chr(10) || 'Response:' || chr(10) || response) - length(response) AS rs
  FROM qr WHERE length(response) > 0
),"""
    + S.segment_cte("st", "fulltext", ["sample_id"], "full_text", NL, 1, start="rs", keep=["rs"])
    + """
SELECT sample_id, step_id, step_start, step_end, delim_start, delim_end, rs::BIGINT AS response_start_char FROM st""",
)(_p16)


# --- P3 / P4 on derived examples ---------------------------------------------


def derived_examples(spark, sf_dir):
    """Trace variants: a full-width ``Solution：`` header (doc_id % 3 = 0),
    lines 2-4 in think tags (% 3 = 1), plain (% 3 = 2); blank text when
    doc_id % 13 = 0."""
    tr = derived_traces(table(spark, sf_dir, "documents"))
    parts = F.split("response", "\n\n", -1)
    think = F.concat(
        F.element_at(parts, 1),
        F.lit("\n\n<think>"),
        F.array_join(F.slice(parts, 2, 3), "\n\n"),
        F.lit("</think>\n\n"),
        F.array_join(F.slice(parts, 5, 1 << 30), "\n\n"),
    )
    text = (
        F.when(F.col("doc_id") % 13 == 0, F.lit(""))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Solution： "), F.col("response")))
        .when(F.col("doc_id") % 3 == 1, think)
        .otherwise(F.col("response"))
    )
    return tr.select("doc_id", text.alias("text"))


SQL_EXAMPLES = (
    S.traces_cte()
    + """,
ex AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ''
      WHEN doc_id % 3 = 0 THEN 'Solution： ' || response
      WHEN doc_id % 3 = 1 THEN string_split(response, chr(10)||chr(10))[1] || chr(10) || chr(10) || '<think>'
           || array_to_string(string_split(response, chr(10)||chr(10))[2:4], chr(10)||chr(10)) || '</think>' || chr(10) || chr(10)
           || array_to_string(string_split(response, chr(10)||chr(10))[5:], chr(10)||chr(10))
      ELSE response END AS text
  FROM traces
)"""
)


def _p3(spark, sf_dir):
    ex = derived_examples(spark, sf_dir)
    parsed = parse_reasoning(ex, "doc_id")
    st = segment_regions(parsed, "doc_id", "\n\n")
    return st.select("doc_id", "branch", *STEP_OUT)


register(
    "p3_parse_reasoning",
    "WITH "
    + SQL_EXAMPLES
    + f""",
th AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1) AS inner_,
         regexp_extract(text, '(?i)({SOLUTION_HEADER})', 1) AS h
  FROM ex
),
regions AS (
  SELECT doc_id, text, 'think' AS branch, 0 AS region_idx,
         length(split_part(text, '<think>', 1)) + 7 AS rs, length(split_part(text, '<think>', 1)) + 7 + length(inner_[1]) AS re
  FROM th WHERE len(inner_) = 1
  UNION ALL
  SELECT doc_id, text, 'header', 0, instr(text, h) - 1 + length(h), length(text)
  FROM th WHERE len(inner_) = 0 AND h <> ''
),"""
    + S.segment_cte("st", "regions", ["doc_id", "region_idx"], "text", NL2, 2, start="rs", end="re", keep=["branch"])
    + """
SELECT doc_id, branch, step_id, step_start, step_end, delim_start, delim_end FROM st""",
)(_p3)


def _p3_examples(spark, sf_dir):
    ex = reasoning_examples(derived_examples(spark, sf_dir), "doc_id", question_sample_prob=0.4)
    return ex.select(
        "doc_id",
        "branch",
        F.md5("text").alias("text_md5"),
        F.coalesce("n_steps", F.lit(-1)).cast("long").alias("n_steps"),
        F.coalesce(F.aggregate("step_starts", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(-1)).alias("sum_starts"),
    )


register(
    "p3_reasoning_examples",
    ORACLE_SQL["p3_parse_reasoning"].rsplit("SELECT doc_id, branch, step_id", 1)[0].rstrip()
    + """,
drawn AS (
  SELECT doc_id, text FROM th WHERE len(inner_) = 0 AND h = '' AND nullif(text, '') IS NOT NULL
  AND (('0x' || substr(md5(doc_id::VARCHAR || '|42'), 1, 12))::BIGINT / 281474976710656.0) < 0.4
),
stepped AS (SELECT doc_id, any_value(branch) AS branch, count(*) AS n_steps, sum(step_start) AS sum_starts FROM st GROUP BY doc_id)
SELECT s.doc_id, s.branch, md5(th.text) AS text_md5, n_steps::BIGINT AS n_steps, sum_starts::BIGINT AS sum_starts FROM stepped s JOIN th USING (doc_id)
UNION ALL
SELECT doc_id, 'question', md5(text), -1, -1 FROM drawn""",
)(_p3_examples)
