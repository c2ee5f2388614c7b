"""Span/interval matching between steps and tokens, and activation points.

A text is cut into steps and tokens in the same row-local pass, and the two
sorted lists of spans are merged there: the last token that overlaps
``[s, e)`` is the last one that starts before ``e``, if it ends after ``s``.
Nothing is exploded, shuffled or joined, and texts that share an id keep
their own points.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField

from tracelab.operators.segment import cut_steps, per_text, region_inputs, word_spans

Spans = Callable[[str], Iterable[tuple[int, int]]]
STRATEGIES = ("step_delimiter",)


def point_finder(tokens: list[tuple[int, int]]) -> Callable:
    """J1 + J2 among the tokens of a text: a function from a step's start and
    end and those of its delimiter (or None) to the last token that overlaps
    the delimiter, else the last that overlaps the step, else None.

    Tokens are in order of start and end; empty ones (as tokenizers give to
    marks that are not in the text) overlap nothing."""
    real = [i for i, (s, e) in enumerate(tokens) if e > s]
    starts, ends = [tokens[i][0] for i in real], [tokens[i][1] for i in real]

    def last(s: int, e: int) -> int | None:
        at = bisect_left(starts, e)
        return real[at - 1] if at and ends[at - 1] > s else None

    def find(begin: int, end: int, delim_begin: int | None, delim_end: int | None) -> int | None:
        after = None if delim_begin is None else last(delim_begin, delim_end)
        return last(begin, end) if after is None else after

    return find


def last_overlaps(tokens: list[tuple[int, int]], steps: Iterable[tuple]) -> Iterator[int | None]:
    """The point of each step (number, start, end, delimiter start and end, body)."""
    find = point_finder(tokens)
    for _, begin, end, delim_begin, delim_end, _ in steps:
        yield find(begin, end, delim_begin, delim_end)


def _pass(df: DataFrame, text_col: str, id_cols, keep, fields: list[StructField], rows: Callable, delim: str, start, end, regions, spans: Spans, max_len: int | None, strategy: str) -> DataFrame:
    """``rows(text, tokens, steps, points)`` of every text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unsupported activation point strategy: {strategy}")
    delim = delim or "\n\n"
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    where, regions_of = region_inputs(text_col, start, end, regions)

    def run(t: str, *at) -> Iterator[tuple]:
        steps = list(cut_steps(t, regions_of(*at), delim))
        tokens = list(islice(spans(t), max_len))
        return rows(t, tokens, steps, list(last_overlaps(tokens, steps)))

    return per_text(df, [F.col(text_col), *where], [*ids, *(k for k in keep if k not in ids)], fields, run)


def activation_points(
    df: DataFrame, text_col: str, id_cols, delim: str = "\n\n", start=None, end=None, regions=None, spans: Spans = word_spans,
    max_len: int | None = None, strategy: str = "step_delimiter", keep=(), details: bool = False,
) -> DataFrame:
    """J1 + J2: the token of every step of every text (delimiter first, else
    step, else null).  ``spans`` is the tokenizer (X2), of whose tokens the
    first ``max_len`` count; the regions are those of ``segment_steps``.
    Output: ids..., keep..., step_id, token_idx; with ``details`` also ``token``
    (text of the token) and ``n_tokens`` (tokens of the text)."""

    def rows(t, tokens, steps, points) -> Iterator[tuple]:
        for (step, *_), point in zip(steps, points, strict=True):
            more = (None if point is None else t[slice(*tokens[point])], len(tokens)) if details else ()
            yield step, point, *more

    fields = [StructField("step_id", LongType()), StructField("token_idx", LongType())]
    fields += [StructField("token", StringType()), StructField("n_tokens", LongType())] if details else []
    return _pass(df, text_col, id_cols, keep, fields, rows, delim, start, end, regions, spans, max_len, strategy)


def point_masks(
    df: DataFrame, text_col: str, id_cols, delim: str = "\n\n", start=None, end=None, regions=None, spans: Spans = word_spans,
    max_len: int | None = None, strategy: str = "step_delimiter", keep=(),
) -> DataFrame:
    """Per text the distinct selected tokens, sorted.
    Output: ids..., keep..., n_steps, n_tokens, points (one row per text that is not null)."""

    def rows(t, tokens, steps, points) -> Iterator[tuple]:
        yield len(steps), len(tokens), sorted({p for p in points if p is not None})

    fields = [StructField("n_steps", LongType()), StructField("n_tokens", LongType()), StructField("points", ArrayType(LongType()))]
    return _pass(df, text_col, id_cols, keep, fields, rows, delim, start, end, regions, spans, max_len, strategy)


def mark_tokens(
    df: DataFrame, text_col: str, id_cols, delim: str = "\n\n", start=None, end=None, regions=None, spans: Spans = word_spans,
    max_len: int | None = None, strategy: str = "step_delimiter", keep=(),
) -> DataFrame:
    """The tokens of every text with ``activation_mask``, whether one is selected.
    Output: ids..., keep..., token_idx, tok_start, tok_end, activation_mask."""

    def rows(t, tokens, steps, points) -> Iterator[tuple]:
        chosen = set(points)
        for i, (s, e) in enumerate(tokens):
            yield i, s, e, i in chosen

    fields = [StructField(c, LongType()) for c in ("token_idx", "tok_start", "tok_end")] + [StructField("activation_mask", BooleanType())]
    return _pass(df, text_col, id_cols, keep, fields, rows, delim, start, end, regions, spans, max_len, strategy)


def keep_usable(masks: DataFrame, min_tokens: int = 10) -> DataFrame:
    """Of the texts of :func:`point_masks`, those with ``min_tokens`` tokens
    and a selected one.  (A blank text has no steps, so no selected token.)"""
    return masks.filter((F.col("n_tokens") >= min_tokens) & (F.size("points") > 0))


def attach_activations(steps: DataFrame, activations: DataFrame, keys=("sample_id", "token_idx")) -> DataFrame:
    """Inner equi join of labelled steps with activation rows; steps with
    a null token index or beyond the captured length fall out."""
    return steps.filter(F.col("token_idx").isNotNull()).join(activations, list(keys), "inner")


def capture_counts(steps: DataFrame, activations: DataFrame, keys=("sample_id", "token_idx")) -> DataFrame:
    """J4 counts: labelled steps, captured steps, and the difference."""
    a = activations.select(*keys).distinct().withColumn("_hit", F.lit(1))
    j = steps.join(a, list(keys), "left")
    return j.agg(
        F.count(F.lit(1)).alias("labeled"),
        F.count("_hit").alias("captured"),
        (F.count(F.lit(1)) - F.count("_hit")).alias("missing"),
    )


def select_points(df: DataFrame, masks=("activation_mask", "extraction_mask", "attention_mask")) -> DataFrame:
    """Token rows kept by the first mask column present, else all."""
    present = [m for m in masks if m in df.columns]
    if not present:
        return df
    return df.filter(F.coalesce(F.col(present[0]).cast("boolean"), F.lit(False)))
