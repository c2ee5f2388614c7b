"""Text column expressions with Python string semantics, JVM-side.

Offsets everywhere are code points (Spark ``length``/``substring`` count code
points).  "Whitespace" means what Python's ``str.isspace`` accepts, which is
Java's Unicode ``\\s`` plus the separators U+001C..U+001F; the class is spelled
out so the same pattern runs in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's whitespace set as one regex character class.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = r"[^\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same set as plain characters, for the character-set trim functions.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# Line boundaries of Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

LINE_BREAK_CHARS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# Candidate column names, in priority order.
COMBINED_TEXT_FIELDS = ("text", "content", "response", "output", "completion")
QUERY_FIELDS = ("problem", "question", "query", "prompt", "instruction", "input")
SOLUTION_FIELDS = ("solution", "answer", "final_answer", "target")
GENERAL_TEXT_FIELDS = ("text", "content", "document")

# Header patterns (case-insensitive; ASCII or full-width colon).
SOLUTION_HEADER = r"(?:Solution|Answer|解答|答案)" + WS + r"*[:：]" + WS + r"*"
FINAL_ANSWER_HEADER = r"(?:Final Answer|Answer)" + WS + r"*[:：]" + WS + r"*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Bind ``value`` once and use it several times in ``fn(v)``: a
    one-element lambda keeps the optimizer from copying an expensive
    expression into each place that reads it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def regex_quote(s: str) -> str:
    """Quote a literal for Java regex and RE2 alike."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace (codegen'd
    character-set trim, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def py_rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(WS_CHARS))


def lead_ws(c) -> Column:
    """Number of leading whitespace code points."""
    return F.length(_c(c)) - F.length(F.ltrim(_c(c), F.lit(WS_CHARS)))


def trail_ws(c) -> Column:
    return F.length(_c(c)) - F.length(F.rtrim(_c(c), F.lit(WS_CHARS)))


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def normalize_text(df_schema: T.StructType, name: str) -> Column:
    """A dataset field as text.

    null -> null; string as is; list -> stripped non-blank items joined by
    newline (empty -> null); struct/map -> null; anything else cast to string.
    Dispatch happens on the schema, so it costs nothing per row.
    """
    dt = df_schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.ArrayType):
        items = F.transform(c, lambda x: py_strip(x.cast("string")))
        kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
        return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))
    if isinstance(dt, (T.StructType, T.MapType)):
        return F.lit(None).cast("string")
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def first_text(df_schema: T.StructType, candidates) -> Column:
    """First candidate column whose normalized value is non-empty.

    A whitespace-only value counts as non-empty.  Columns absent from the
    schema are skipped at plan time.
    """
    present = [c for c in candidates if c in df_schema.fieldNames()]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(normalize_text(df_schema, c), F.lit("")) for c in present])


def extract_final_answer(c) -> Column:
    """Text after the first ``Final Answer:``/``Answer:`` header (stripped),
    else the last non-blank stripped line; null for null/empty input."""
    c = _c(c)
    # one regex pass, and only on texts that contain "answer" at all; the
    # captured tail is never empty when the header matches
    maybe = F.instr(F.lower(c), "answer") > 0
    tail = F.when(maybe, F.regexp_extract(c, "(?is)" + FINAL_ANSWER_HEADER + "(.+)", 1)).otherwise(F.lit(""))
    # last non-blank line: strip trailing whitespace, then take the text
    # after the last line break (found from the end via reverse + split).
    last_line = F.nullif(
        py_strip(F.reverse(F.element_at(F.split(F.reverse(py_rstrip(c)), LINE_BREAK_CHARS, 2), 1))), F.lit("")
    )
    picked = let(tail, lambda t: F.when(t != "", py_strip(t)).otherwise(last_line))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(picked)


def normalize_answer(c) -> Column:
    """Collapse whitespace runs, strip, lower-case; empty -> null."""
    return F.nullif(F.lower(py_strip(F.regexp_replace(_c(c), WS + "+", " "))), F.lit(""))


def answer_match(pred, ref) -> Column:
    """Null when the reference is null/empty; else normalized equality
    (null-safe, as two missing answers compare equal)."""
    ref = _c(ref)
    return F.when(ref.isNotNull() & (ref != ""), normalize_answer(pred).eqNullSafe(normalize_answer(ref)))


def render_prompt(template: str, question) -> Column:
    """P10: ``{question}`` in the template replaced by the stripped question."""
    return F.replace(F.lit(template), F.lit("{question}"), py_strip(question))
