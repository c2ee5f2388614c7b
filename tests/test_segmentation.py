"""Step segmentation, activation points and reasoning parsing (golden cases)."""

from pyspark.sql import functions as F

from tracelab.operators.segment import char_spans, parse_reasoning, reasoning_examples, segment_regions, segment_steps, tokenize_words
from tracelab.operators.spans import activation_points, keep_usable, last_overlaps, mark_tokens, point_masks, select_points

TEXT = "First compute the sum.\n\nThen conclude the answer is 2."


def _steps(spark, text, delim="\n\n", start=None, end=None):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    kw = {}
    if start is not None:
        df = df.withColumn("s", F.lit(start)).withColumn("e", F.lit(end))
        kw = {"start": "s", "end": "e"}
    return sorted(segment_steps(df, "text", "id", delim, **kw).collect(), key=lambda r: r.step_id)


def test_two_steps_and_delimiter_span(spark):
    st = _steps(spark, TEXT)
    assert len(st) == 2
    assert TEXT[st[0].step_start : st[0].step_end] == "First compute the sum."
    assert TEXT[st[0].delim_start : st[0].delim_end] == "\n\n"
    assert TEXT[st[1].step_start : st[1].step_end] == "Then conclude the answer is 2."
    assert st[1].delim_start is None and st[1].delim_end is None
    assert [r.step_text for r in st] == ["First compute the sum.", "Then conclude the answer is 2."]


def test_points_delimiter_then_last_step_token(spark):
    df = spark.createDataFrame([(1, TEXT)], "id long, text string")
    pts = activation_points(df, "text", "id", spans=char_spans, max_len=4096, details=True).collect()
    assert [(r.step_id, r.token_idx, r.token, r.n_tokens) for r in pts] == [(0, 23, "\n", len(TEXT)), (1, len(TEXT) - 1, ".", len(TEXT))]
    mask = point_masks(df, "text", "id", spans=char_spans, max_len=4096).first()
    assert (mask.n_steps, mask.n_tokens, mask.points) == (2, len(TEXT), [23, len(TEXT) - 1])


def test_problem_solution_schema(spark):
    df = spark.createDataFrame([(0, "What is 1 + 1?", TEXT)], "id long, problem string, solution string")
    parsed = parse_reasoning(df, "id")
    row = parsed.first()
    assert row.text.startswith("Problem:\nWhat is 1 + 1?")
    steps = segment_regions(parsed, "id", "\n\n")
    assert steps.count() == 2
    mask = point_masks(parsed, "text", "id", regions="regions", spans=char_spans, max_len=4096).first()
    assert len(mask.points) == 2


def test_unicode_blanks_are_trimmed(spark):
    text = "  alpha　\n\n\x1c\n\nbeta  "
    st = _steps(spark, text)
    assert [r.step_text for r in st] == ["alpha", "beta"]
    assert [r.step_id for r in st] == [0, 1]
    assert text[st[0].step_start : st[0].step_end] == "alpha"


def test_delimiter_at_start_and_end(spark):
    text = "\n\nonly step\n\n"
    st = _steps(spark, text)
    assert len(st) == 1
    assert st[0].step_text == "only step"
    assert (st[0].delim_start, st[0].delim_end) == (11, 13)


def test_region_offsets_are_absolute(spark):
    text = "Q: ignore me\n\nA: one\n\ntwo"
    st = _steps(spark, text, start=14, end=len(text))
    assert [text[r.step_start : r.step_end] for r in st] == ["A: one", "two"]


def test_think_and_header_regions(spark):
    rows = [
        (1, "intro <think>a\n\nb</think> tail <think>c</think>"),
        (2, "Question here. 答案： step one\n\nstep two"),
        (3, "no region at all"),
    ]
    df = spark.createDataFrame(rows, "id long, text string")
    parsed = parse_reasoning(df, "id")
    steps = segment_regions(parsed, "id", "\n\n").orderBy("id", "step_id").collect()
    by = {}
    for r in steps:
        by.setdefault(r.id, []).append(r.step_text)
    assert by[1] == ["a", "b", "c"]
    assert by[2] == ["step one", "step two"]
    assert 3 not in by


def test_word_tokens_and_truncation(spark):
    df = spark.createDataFrame([(1, "  ab c　d  ")], "id long, text string")
    toks = tokenize_words(df, "text", "id", max_len=2).orderBy("token_idx").collect()
    assert [(t.token, t.tok_start, t.tok_end) for t in toks] == [("ab", 2, 4), ("c", 5, 6)]


def test_texts_of_one_id_keep_their_own_points(spark):
    texts = ["alpha beta\n\ngamma", "x\n\ny z\n\nw", None, "", "one two three four five six seven eight nine ten"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "id long, n int, text string")
    got = sorted((r.n, r.step_id, r.token) for r in activation_points(df, "text", "id", keep=("n",), details=True).collect())
    assert got == [(0, 0, "beta"), (0, 1, "gamma"), (1, 0, "x"), (1, 1, "z"), (1, 2, "w"), (4, 0, "ten")]
    masks = {r.n: r.points for r in point_masks(df, "text", "id", keep=("n",)).collect()}
    assert masks == {0: [1, 2], 1: [0, 2, 3], 3: [], 4: [9]}
    assert [r.n for r in keep_usable(point_masks(df, "text", "id", keep=("n",)), 10).collect()] == [4]
    chosen = sorted((r.n, r.token_idx) for r in select_points(mark_tokens(df, "text", "id", keep=("n",))).collect())
    assert chosen == [(n, p) for n, ps in sorted(masks.items()) for p in ps]
    plan = activation_points(df, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_empty_tokens_and_unordered_regions():
    tokens = [(0, 0), (0, 2), (2, 3), (3, 6), (0, 0)]  # marks that are not in the text in front and behind
    steps = [(0, 0, 2, 2, 3, ""), (1, 3, 6, None, None, "")]
    assert list(last_overlaps(tokens, steps)) == [2, 3]
    assert list(last_overlaps(tokens, [steps[1], steps[0]])) == [3, 2]
    assert list(last_overlaps([], steps)) == [None, None]


def test_reasoning_examples_with_fallback(spark):
    rows = [(i, "Q", "one\n\ntwo", None) for i in range(3)] + [(10, None, None, "<think> \n\n </think>"), (11, None, None, "Answer: a\n\nb")]
    rows += [(100 + i, "only a question" if i % 2 else None, None, None if i % 3 else "plain text") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, question string, solution string, text string")
    got = {r.id: r for r in reasoning_examples(df, "id", question_sample_prob=0.25).collect()}
    assert got[0].branch == "qa" and got[0].n_steps == 2 and 10 not in got
    assert got[11].branch == "header" and [got[11].text[s:e] for s, e in zip(got[11].step_starts, got[11].step_ends)] == ["a", "b"]
    drawn = [r for i, r in got.items() if i >= 100]
    able = sum(1 for r in rows[5:] if r[1] or r[3])
    assert 0.15 < len(drawn) / able < 0.35
    assert all(r.branch == "question" and r.n_steps is None and r.text in ("only a question", "plain text") for r in drawn)
    assert all((r.text == "only a question") == (r.id % 2 == 1) for r in drawn)
    assert all(r.branch != "question" for r in reasoning_examples(df, "id", question_sample_prob=0.0).collect())
