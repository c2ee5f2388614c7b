"""Row-local segmentation and tokens: repeated ids, nulls, regions, user tokenizers, batch bounds."""

import re

from pyspark.sql import functions as F

from tracelab.operators import segment
from tracelab.operators.segment import question_fallback, segment_steps, tokenize, tokenize_words


def test_repeated_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, "d e"), (2, None), (3, "")], "i long, t string")
    words = sorted((r.i, r.token_idx, r.tok_start, r.tok_end, r.token) for r in tokenize_words(df, "t", "i").collect())
    assert words == sorted([(1, 0, 0, 2, "ab"), (1, 1, 3, 4, "c"), (1, 0, 0, 1, "d"), (1, 1, 2, 3, "e")])
    steps = sorted((r.i, r.step_id, r.step_start, r.step_end, r.step_text) for r in segment_steps(df, "t", "i", " ").collect())
    assert steps == sorted([(1, 0, 0, 2, "ab"), (1, 1, 3, 4, "c"), (1, 0, 0, 1, "d"), (1, 1, 2, 3, "e")])


def test_no_shuffle(spark):
    df = spark.range(10).select("id", F.lit("a b\n\nc").alias("t"))
    for out in (segment_steps(df, "t", "id"), tokenize_words(df, "t", "id")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_region_in_code_points(spark):
    df = spark.createDataFrame([(1, "😀😀 x\n\n é y \n\nz", 3, 12)], "i long, t string, s long, e long")
    got = [(r.step_start, r.step_end, r.delim_start, r.step_text) for r in segment_steps(df, "t", "i", start="s", end="e", keep=("s",)).collect()]
    assert got == [(3, 4, 4, "x"), (7, 10, None, "é y")]


def test_user_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab12cd3")], "i long, t string")
    rows = tokenize(df, "t", "i", lambda t: [m.span() for m in re.finditer(r"[a-z]+|\d+", t)], max_len=3).collect()
    assert [(r.token_idx, r.tok_start, r.tok_end, r.token) for r in rows] == [(0, 0, 2, "ab"), (1, 2, 4, "12"), (2, 4, 6, "cd")]


def test_long_texts_cross_batches(spark, monkeypatch):
    monkeypatch.setattr(segment, "PIECE_ROWS", 7)
    df = spark.range(5).select("id", F.repeat(F.lit("w "), 40).alias("t"))
    got = tokenize_words(df, "t", "id", keep=("t",)).groupBy("id").agg(F.count("*").alias("n"), F.max("tok_end").alias("e")).collect()
    assert sorted((r.id, r.n, r.e) for r in got) == [(i, 40, 79) for i in range(5)]


def test_fallback_leaves_rows_with_a_region(spark):
    rows = [(1, "q", "s", None), (2, "q", None, None), (3, None, None, "x <think>y</think>"), (4, None, None, "Solution: z"), (5, None, None, "plain")]
    df = spark.createDataFrame(rows, "i long, question string, solution string, text string")
    assert {r.i: r.text for r in question_fallback(df, "i", p=1.0).collect()} == {2: "q", 5: "plain"}


def test_label_means_on_a_wide_grid(spark):
    from tracelab.operators.scoring import label_means

    rows = [(0, 3, 0, 2.0), (0, 3, 0, 4.0), (0, 30_000, 1, 1.0), (1, 5, 0, 1.5)]
    df = spark.createDataFrame(rows, "label int, latent_id long, rank int, value double")
    out = label_means(df, 32_768)
    assert out.count() == 2 * 32_768
    got = {(r.label, r.latent_id): (r.mean_activation, r.num_steps) for r in out.where("mean_activation > 0").collect()}
    assert got == {(0, 3): (3.0, 2), (0, 30_000): (0.5, 2), (1, 5): (1.5, 1)}


def test_an_answer_is_read_at_a_time():
    """The JSON of answers is looked for on Arrow's own rows; a batch's texts are not all made Python strings."""
    import pyarrow as pa

    from tracelab.functions.judge import strict_label

    got = strict_label.func(pa.array(['{"label": "Other", "rationale": 3}', None, "no", '{"label": "reflection", "rationale": "cut']))
    assert isinstance(got, pa.StructArray)
    assert got.to_pylist() == [{"label": "other", "rationale": "3"}, {"label": None, "rationale": None}, {"label": None, "rationale": None}, {"label": "reflection", "rationale": "cut"}]
    assert segment.PIECE_CHARS <= 1 << 22
