"""Data derived from the driver tables to play the roles of the reference's
inputs (reasoning traces, question/response pairs, intervention runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators.segment import evaluate_once
from tracelab.session import spread

# Cue prefixes of the derived traces, chosen by (doc_id*7 + line) % 5.
TRACE_PREFIXES = ("Wait, let me verify. ", "Alternatively, ", "Wait, instead ")
# Intervention conditions (name:alpha).
DEFAULT_CONDITIONS = "negative:1.0,vanilla:0.0,positive:-1.0"


def derived_traces(documents: DataFrame, keep=()) -> DataFrame:
    """One reasoning trace per document: cue-prefixed lines joined by blank
    lines plus ``Final Answer: doc_id % 10``; every seventh reference answer
    is null; the question is the document's first line.
    Output: doc_id, response, reference_answer, question, keep..."""
    lines = F.split(F.trim(F.col("text")), "\n", -1)

    def pref(x, i):
        m = F.pmod(F.col("doc_id") * 7 + i, F.lit(5))
        p = (
            F.when(m == 0, F.lit(TRACE_PREFIXES[0]))
            .when(m == 1, F.lit(TRACE_PREFIXES[1]))
            .when(m == 2, F.lit(TRACE_PREFIXES[2]))
            .otherwise(F.lit(""))
        )
        return F.concat(p, x)

    resp = F.concat(
        F.array_join(F.transform(lines, pref), "\n\n"),
        F.lit("\n\nFinal Answer: "),
        (F.col("doc_id") % 10).cast("string"),
    )
    ref = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 10).cast("string"))
    # built once per row, whatever reads the response later
    question = F.split(F.trim(F.col("text")), "\n", 2).getItem(0)
    return evaluate_once(
        spread(documents).select("doc_id", resp.alias("response"), ref.alias("reference_answer"), question.alias("question"), *keep)
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Question/response pairs: a user turn and the assistant turn right
    after it.  One window per conversation (bounded by its length).
    Output: sample_id (conv_id*1000+turn), conv_id, turn, question, response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
    )
    return nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.col("next_text").alias("response"),
    )
