"""Step segmentation, tokenization with offsets, reasoning-text parsing.

Segmentation (X1) and tokenization (X2) turn one text into many rows with
code-point offsets.  Both are row-local passes over Arrow batches: a text's
pieces depend on its row alone, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tracelab.functions.text import (
    COMBINED_TEXT_FIELDS,
    GENERAL_TEXT_FIELDS,
    QUERY_FIELDS,
    SOLUTION_FIELDS,
    SOLUTION_HEADER,
    first_text,
    py_strip,
)

STEP_COLUMNS = ("step_id", "step_start", "step_end", "delim_start", "delim_end")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Bound of what one Arrow batch of pieces carries: rows, and characters of the texts kept beside them.
PIECE_ROWS, PIECE_CHARS = 16_384, 1 << 22


#: Arrow types of the columns that ``per_text`` makes.
KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def per_text(df: DataFrame, inputs: list[Column], passed: list[str], fields: list[StructField], pieces: Callable) -> DataFrame:
    """Rows (a tuple of ``fields``) that ``pieces`` makes of each row's
    ``inputs``, beside the columns ``passed``.  Row-local: no shuffle, and rows
    that share an id stay apart.  A row with a null input gives none."""
    n, n_in = len(passed), len(inputs)
    weighed = n > 1 or any(isinstance(f.dataType, ArrayType) for f in fields)  # a row carries as much as its text
    staged = df.select(*passed, *[c.alias(f"_in{i}") for i, c in enumerate(inputs)])
    schema = StructType([*staged.schema.fields[:n], *fields])
    kinds = [KINDS[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            beside = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*beside, *made], names=schema.names)

        for b in batches:
            at, rows, chars = [], [], 0
            for i, given in enumerate(zip(*((x.as_py() for x in b.column(n + j)) for j in range(n_in)), strict=True)):  # a row at a time
                if any(x is None for x in given):
                    continue
                for row in pieces(*given):
                    at.append(i)
                    rows.append(row)
                    chars += len(given[0]) if weighed else 0
                    if len(rows) >= PIECE_ROWS or chars >= PIECE_CHARS:
                        yield out(b, at, rows)
                        at, rows, chars = [], [], 0
            if rows:
                yield out(b, at, rows)

    return staged.mapInArrow(run, schema)


def _long(name: str) -> StructField:
    return StructField(name, LongType())


def word_spans(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of anything but white space."""
    return (m.span() for m in re.finditer(r"\S+", text))


def char_spans(text: str) -> Iterator[tuple[int, int]]:
    return ((i, i + 1) for i in range(len(text)))


def cut_steps(text: str, regions: Iterable[tuple[int, int]], delim: str) -> Iterator[tuple]:
    """(step, start, end, delimiter start, delimiter end, body) of the pieces of
    a text's regions, numbered through."""
    step = 0
    for lo, hi in regions:
        at = lo
        parts = text[lo:hi].split(delim)
        for i, part in enumerate(parts):
            stop = at + len(part)
            body = part.strip()
            if body:
                begin = stop - len(part.lstrip())
                after = (stop, stop + len(delim)) if i + 1 < len(parts) else (None, None)
                yield step, begin, begin + len(body), *after, body
                step += 1
            at = stop + len(delim)


def region_inputs(text_col: str, start=None, end=None, regions=None) -> tuple[list[Column], Callable]:
    """The columns that say where a text is cut, and a function from their
    values to (start, end) pairs."""
    if regions is not None:
        return [_c(regions)], lambda spans: [(r["start"], r["end"]) for r in spans]
    first = F.lit(0) if start is None else _c(start)
    last = F.length(F.col(text_col)) if end is None else _c(end)
    return [first, last], lambda lo, hi: [(lo, hi)]


def segment_steps(
    df: DataFrame,
    text_col: str,
    id_cols,
    delim: str = "\n\n",
    start=None,
    end=None,
    keep=(),
    with_text: bool = True,
    regions=None,
    with_context: bool = False,
) -> DataFrame:
    """Cut the region ``[start, end)`` of every text into steps.

    Left-to-right literal split on ``delim`` inside the region; each piece is
    trimmed of Python whitespace and dropped when blank; spans are half-open
    code-point offsets into the full text; the delimiter span is the one that
    *follows* the piece (null for the last piece); ``step_id`` counts kept
    pieces from 0.  ``start``/``end`` default to the whole text; ``regions``
    (array of start, end) cuts several, step ids continuing from one to the
    next.  ``with_context`` adds the texts of the steps before and after (W1).
    Output: ids..., keep..., step_id, step_start, step_end, delim_start,
    delim_end (BIGINT) [, step_text] [, previous_step, next_step].
    """
    delim = delim or "\n\n"
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    passed = [*ids, *(k for k in keep if k not in ids)]
    where, spans = region_inputs(text_col, start, end, regions)

    def steps(t: str, *at) -> Iterator[tuple]:
        for row in cut_steps(t, spans(*at), delim):
            yield row if with_text else row[:-1]

    def in_context(t: str, *at) -> Iterator[tuple]:
        rows = list(cut_steps(t, spans(*at), delim))
        for i, row in enumerate(rows):
            near = rows[i - 1][-1] if i else None, rows[i + 1][-1] if i + 1 < len(rows) else None
            yield (*(row if with_text else row[:-1]), *near)

    # One row a text from Python, its steps as lists: what is kept beside them
    # goes to the steps in Spark, which leaves out the columns nobody reads.
    texts = ["step_text"] * with_text + ["previous_step", "next_step"] * with_context
    names = [*STEP_COLUMNS, *texts]

    def listed(*given) -> Iterator[tuple]:
        if rows := list((in_context if with_context else steps)(*given)):
            yield tuple(zip(*rows, strict=True))

    fields = [StructField(f"_{c}", ArrayType(StringType() if c in texts else LongType())) for c in names]
    per = per_text(df, [F.col(text_col), *where], passed, fields, listed)
    return per.select(*passed, F.inline(F.arrays_zip(*[F.col(f"_{c}").alias(c) for c in names])))


def tokenize(df: DataFrame, text_col: str, id_cols, spans: Callable[[str], Iterable[tuple[int, int]]], max_len: int | None = None, keep=()) -> DataFrame:
    """X2 with any tokenizer: ``spans`` gives the (start, end) code points of a
    text's tokens in order.  All tokens, or the first ``max_len`` if given.
    Output: ids..., keep..., token_idx, tok_start, tok_end (BIGINT), token.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)

    def tokens(t: str) -> Iterator[tuple]:
        for i, (s, e) in enumerate(islice(spans(t), max_len)):
            yield i, s, e, t[s:e]

    fields = [_long("token_idx"), _long("tok_start"), _long("tok_end"), StructField("token", StringType())]
    return per_text(df, [F.col(text_col)], [*ids, *keep], fields, tokens)


def tokenize_words(df: DataFrame, text_col: str, id_cols, max_len: int | None = None, keep=()) -> DataFrame:
    """X2 (default tokenizer): maximal non-whitespace runs with offsets."""
    return tokenize(df, text_col, id_cols, word_spans, max_len, keep)


def tokenize_chars(df: DataFrame, text_col: str, id_cols, max_len: int | None = None, keep=()) -> DataFrame:
    """X2 ``char`` mode: one token per code point (the test tokenizer)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    chars = F.split(F.col(text_col), "(?s)(?!$)", -1)
    chars = chars if max_len is None else F.slice(chars, 1, max_len)
    return df.select(*ids, *keep, F.posexplode(chars).alias("token_idx", "token")).select(
        *ids,
        *keep,
        F.col("token_idx").cast("long").alias("token_idx"),
        F.col("token_idx").cast("long").alias("tok_start"),
        (F.col("token_idx") + 1).cast("long").alias("tok_end"),
        "token",
    )


# ---------------------------------------------------------------------------
# reasoning-text parsing
# ---------------------------------------------------------------------------


def think_regions(text_col: str) -> Column:
    """Inner spans of every ``<think>...</think>`` (non-greedy, dot-all) as
    ``array<struct<start, end>>`` in code points, computed in the row."""
    t = F.col(text_col)
    # split on the tags: odd pieces after "<think>" up to the next "</think>"
    inner = F.regexp_extract_all(t, F.lit(r"(?s)<think>(.*?)</think>"), 1)
    whole = F.regexp_extract_all(t, F.lit(r"(?s)(<think>.*?</think>)"), 1)
    gaps = F.split(t, r"(?s)<think>.*?</think>", -1)
    # start of match i = Σ_{j<=i} len(gap_j) + Σ_{j<i} len(whole_j) + len("<think>")
    idx = F.sequence(F.lit(0), F.size(inner) - 1)

    def span(i):
        pre_gaps = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g))
        pre_whole = F.aggregate(
            F.slice(F.concat(whole, F.array(F.lit(""))), 1, i), F.lit(0), lambda a, g: a + F.length(g)
        )
        st = pre_gaps + pre_whole + F.lit(7)
        return F.struct(st.cast("long").alias("start"), (st + F.length(F.element_at(inner, i + 1))).cast("long").alias("end"))

    return F.when(F.size(inner) > 0, F.transform(idx, span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def evaluate_once(df: DataFrame) -> DataFrame:
    """Keep the optimizer from inlining the expensive columns of ``df`` into
    every expression that reads them (a generator is a projection barrier;
    the row count is unchanged)."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def parse_reasoning(df: DataFrame, id_col: str, retain_query: bool = True, delim: str = "\n\n", question_sample_prob: float | None = None, seed: int = 42) -> DataFrame:
    """The text of each example and its reasoning regions, one row per example.

    (a) query & solution -> ``Problem:\\n{q}\\n\\nSolution:\\n{s}``, region = the
    solution tail; (b) combined text with think tags -> the inner spans;
    (c) first solution header -> header end to text end; (d) with
    ``question_sample_prob``, an example without a region keeps its query (else
    combined) text with that probability, without regions (branch
    ``question``).  Others are left out.  The draw of (d) is a seeded hash of
    the id, stable across partitioning and retries (K6).
    With ``retain_query=False`` the regions are stripped, blank ones dropped,
    joined by the delimiter (P4) and the whole new text is the region.
    One pass: the branch is chosen per row with CASE; the tag and header
    regexes only run on texts that contain a tag / keyword at all.
    Output: id, text, branch, regions (array of start, end; null for (d)).
    """
    sch = df.schema
    q, s, comb = first_text(sch, QUERY_FIELDS), first_text(sch, SOLUTION_FIELDS), first_text(sch, COMBINED_TEXT_FIELDS)
    base = df.select(F.col(id_col), q.alias("_q"), s.alias("_s"), comb.alias("_c"))
    c = F.col("_c")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    staged = base.select(
        id_col,
        "_q",
        "_s",
        "_c",
        F.when(F.instr(c, "<think>") > 0, think_regions("_c")).otherwise(empty).alias("_think"),
        F.regexp_extract(c, "(?i)(" + SOLUTION_HEADER + ")", 1).alias("_hdr_text"),
    )
    staged = evaluate_once(staged)
    full_a = F.concat(F.lit("Problem:\n"), F.col("_q"), F.lit("\n\nSolution:\n"), F.col("_s"))
    is_a = F.col("_q").isNotNull() & F.col("_s").isNotNull()
    is_b = ~is_a & c.isNotNull() & (F.size("_think") > 0)
    is_c = ~is_a & c.isNotNull() & (F.size("_think") == 0) & (F.col("_hdr_text") != "")
    # first header occurrence == first regex match (an earlier occurrence of
    # the matched text would itself be an earlier match)
    hdr_end = (F.instr(c, F.col("_hdr_text")) - 1 + F.length("_hdr_text")).cast("long")
    region_a = F.array(F.struct((F.length(full_a) - F.length("_s")).cast("long").alias("start"), F.length(full_a).cast("long").alias("end")))
    region_c = F.array(F.struct(hdr_end.alias("start"), F.length(c).cast("long").alias("end")))
    none = ~(is_a | is_b | is_c)
    asked = F.coalesce(F.col("_q"), c)
    if question_sample_prob is None:
        is_d = F.lit(False)
    else:
        from tracelab.operators.sampling import hash_uniform

        is_d = none & asked.isNotNull() & (hash_uniform([id_col], seed) < F.lit(float(question_sample_prob)))
    parsed = staged.select(
        id_col,
        F.when(is_a, full_a).when(none, asked).otherwise(c).alias("text"),
        F.when(is_a, region_a).when(is_b, F.col("_think")).when(is_c, region_c).alias("regions"),
        F.when(is_a, F.lit("qa")).when(is_b, F.lit("think")).when(is_c, F.lit("header")).when(is_d, F.lit("question")).alias("branch"),
    ).filter(F.col("branch").isNotNull())
    if not retain_query:
        chunks = F.filter(
            F.transform("regions", lambda r: py_strip(F.substring("text", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))),
            lambda x: x != "",
        )
        # (two projections: the new text must not shadow the old one)
        parsed = parsed.select(id_col, F.when(F.col("regions").isNull(), F.col("text")).otherwise(F.array_join(chunks, delim)).alias("_joined"), "regions", "branch")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("_joined").cast("long").alias("end")))
        parsed = parsed.select(
            id_col, F.col("_joined").alias("text"), F.when(F.col("regions").isNotNull(), whole).alias("regions"), "branch"
        ).filter(F.length("text") > 0)
    return parsed.select(id_col, "text", "branch", "regions")


def segment_regions(parsed: DataFrame, id_col: str, delim: str = "\n\n") -> DataFrame:
    """X1 over the regions of :func:`parse_reasoning`, step ids continuing
    across the regions of one text (in region order)."""
    return segment_steps(parsed, "text", id_col, delim, regions="regions", keep=("branch",))


def reasoning_examples(df: DataFrame, id_col: str, retain_query: bool = True, delim: str = "\n\n", question_sample_prob: float = 0.1, seed: int = 42) -> DataFrame:
    """P3 whole: one row per example that is used, the steps of its text beside
    it.  An example whose regions hold no step is dropped; one that was kept by
    the draw has no steps (``n_steps`` null).
    Output: id, text, branch, n_steps, step_starts, step_ends, delim_starts, delim_ends."""
    delim = delim or "\n\n"
    parsed = parse_reasoning(df, id_col, retain_query, delim, question_sample_prob, seed)
    # a text without regions goes through with an empty list, marked by its branch
    where = F.coalesce(F.col("regions"), F.array().cast("array<struct<start:bigint,end:bigint>>"))

    def steps(t: str, branch: str, regions: list) -> Iterator[tuple]:
        rows = list(cut_steps(t, [(r["start"], r["end"]) for r in regions], delim))
        if rows:
            yield len(rows), *([row[i] for row in rows] for i in range(1, 5))
        elif branch == "question":
            yield None, None, None, None, None

    lists = [StructField(c, ArrayType(LongType())) for c in ("step_starts", "step_ends", "delim_starts", "delim_ends")]
    return per_text(parsed, [F.col("text"), F.col("branch"), where], [id_col, "text", "branch"], [_long("n_steps"), *lists], steps)


def parse_general(df: DataFrame, id_col: str) -> DataFrame:
    """P5: first non-empty of text/content/document; no steps."""
    t = first_text(df.schema, GENERAL_TEXT_FIELDS)
    return df.select(F.col(id_col), t.alias("text")).filter(F.col("text").isNotNull())


def question_fallback(df: DataFrame, id_col: str, p: float = 0.1, seed: int = 42) -> DataFrame:
    """P3 (d) / K6: rows without a reasoning region keep their query (or
    combined) text with probability p; the draw is a seeded hash of the key,
    stable across partitioning and retries."""
    sch = df.schema
    fb = F.coalesce(first_text(sch, QUERY_FIELDS), first_text(sch, COMBINED_TEXT_FIELDS))
    from tracelab.operators.sampling import hash_uniform

    q, s, comb = first_text(sch, QUERY_FIELDS), first_text(sch, SOLUTION_FIELDS), first_text(sch, COMBINED_TEXT_FIELDS)
    region = comb.rlike("(?s)<think>.*?</think>") | comb.rlike("(?i)" + SOLUTION_HEADER)
    has_region = (q.isNotNull() & s.isNotNull()) | F.coalesce(region, F.lit(False))
    draw = hash_uniform([id_col], seed) < F.lit(float(p))
    return df.filter(draw & ~has_region).select(F.col(id_col), fb.alias("text")).filter(F.col("text").isNotNull())


def extract_question_response(df: DataFrame, id_col: str) -> DataFrame:
    """question/response pair per example plus ``reference_answer``.

    Without a question, the text before a solution header is the question; a
    header with nothing after it leaves the combined text as the response."""
    from tracelab.functions.text import extract_final_answer

    sch = df.schema
    q, r, comb = first_text(sch, QUERY_FIELDS), first_text(sch, SOLUTION_FIELDS), first_text(sch, COMBINED_TEXT_FIELDS)
    b = df.select(F.col(id_col), q.alias("_q"), r.alias("_r"), comb.alias("_c"))
    htxt = F.regexp_extract(F.col("_c"), "(?i)(" + SOLUTION_HEADER + ")", 1)
    # position of the matched text in code points (regex positions are UTF-16 units)
    b = b.select("*", htxt.alias("_h")).withColumn("_p", F.when(F.col("_h") != "", F.instr(F.col("_c"), F.col("_h"))).otherwise(0))
    tail = py_strip(F.substring("_c", (F.col("_p") + F.length("_h")).cast("int"), 1 << 30))
    prefix = py_strip(F.substring("_c", 1, (F.col("_p") - 1).cast("int")))
    found = F.col("_c").isNotNull() & (F.col("_p") > 0)
    asked = F.coalesce(F.col("_q"), F.when(found & (prefix != ""), prefix))
    has_q = asked.isNotNull()
    has_hdr = found & (tail != "")
    question = F.when(F.col("_q").isNotNull() & F.col("_r").isNotNull(), F.col("_q")).when(has_hdr, F.coalesce(asked, F.lit(""))).otherwise(asked)
    response = (
        F.when(F.col("_q").isNotNull() & F.col("_r").isNotNull(), F.col("_r"))
        .when(has_hdr, tail)
        .when(has_q & F.col("_c").isNotNull(), F.col("_c"))
        .when(has_q, F.lit(""))
    )
    ref_src = (
        F.when(F.col("_q").isNotNull() & F.col("_r").isNotNull(), F.col("_r"))
        .when(has_hdr, tail)
        .when(has_q & F.col("_c").isNotNull(), F.col("_c"))
        .otherwise(F.coalesce(F.col("_r"), F.col("_c")))
    )
    return b.select(
        id_col, question.alias("question"), response.alias("response"), extract_final_answer(ref_src).alias("reference_answer")
    ).filter(F.col("question").isNotNull())


def reasoning_samples(qr: DataFrame, id_col: str, delim: str = "\n\n", with_context: bool = False) -> DataFrame:
    """``Question:\\n{q}\\n\\nResponse:\\n{r}``, region = the response tail,
    steps by X1; samples with an empty response or without steps drop out
    (the inner join with the steps does that)."""
    full = F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\n\nResponse:\n"), F.col("response"))
    s = qr.filter(F.length("response") > 0).select(
        id_col,
        "question",
        "response",
        "reference_answer",
        full.alias("full_text"),
        (F.length(full) - F.length("response")).cast("long").alias("response_start_char"),
    )
    return segment_steps(
        s,
        "full_text",
        id_col,
        delim,
        start="response_start_char",
        keep=("question", "response", "reference_answer", "full_text", "response_start_char"),
        with_context=with_context,
    )


def pad_batch(df: DataFrame, batch_col: str, ids_col: str, pad_id: int = 0) -> DataFrame:
    """Pad id arrays of one batch to the batch maximum; attention mask 1/0."""
    w = Window.partitionBy(batch_col)
    m = F.max(F.size(ids_col)).over(w)
    pad = m - F.size(ids_col)
    return df.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), F.array_repeat(F.lit(0), pad))).withColumn(
        ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id).cast("long"), pad))
    )
