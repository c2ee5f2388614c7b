"""Cue-word step labels (heuristic judge) as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue patterns (case-insensitive), in the order of the
# reference heuristic.  Each pattern counts once per step.
REFLECTION_CUES = (
    r"\bwait\b",
    r"double[- ]check",
    r"check again",
    r"just to make sure",
    r"let me verify",
    r"verify that",
    r"let me think again",
    r"reconsider",
    r"does that make sense",
    r"i should make sure",
)
BACKTRACKING_CUES = (
    r"\balternatively\b",
    r"another approach",
    r"instead",
    r"let'?s try",
    r"that (?:won't|will not) work",
    r"different approach",
    r"back up",
    r"start over",
    r"switch to",
    r"rewrite the plan",
)
# The label set and rationales of the heuristic judge.
LABELS = ("reflection", "backtracking", "other")
RATIONALE_HIT = "heuristic cue match"
RATIONALE_MISS = "no heuristic cue match"



def portable(pattern: str) -> str:
    """Rewrite ``\\b`` at a pattern's ends as explicit Unicode boundaries."""
    p = pattern
    if p.startswith(r"\b"):
        p = rf"(?:^|[^\pL\pN_]){p[2:]}"
    if p.endswith(r"\b"):
        p = rf"{p[:-2]}(?:[^\pL\pN_]|$)"
    return "(?i)" + p


def sure_part(pattern: str) -> str:
    """The longest piece of text that every match of a cue pattern has, in lower case."""
    return max(re.split(r"\\b|\(\?:[^)]*\)|\[[^\]]*\]|.\?", pattern), key=len)


def cue_hits(text, patterns, low: Column) -> Column:
    """How many patterns a text matches.  ``low`` is the text in lower case: a
    pattern is only tried where its sure part is in it, a plain search."""
    text = F.col(text) if isinstance(text, str) else text
    hits = [F.coalesce(low.contains(sure_part(p)) & text.rlike(portable(p)), F.lit(False)) for p in patterns]
    return sum(hit.cast("int") for hit in hits)


def cue_label(text, low: Column | None = None) -> Column:
    """Label by strictly more distinct cue hits; tie or none -> other.  ``low``:
    the text in lower case, for callers that have it (inside an array lambda
    it would be taken anew for every cue)."""
    # r > b implies r > 0 (counts are >= 0), so the sign of r - b decides;
    # the difference is referenced once, so every cue regex runs once.
    low = F.lower(text) if low is None else low
    d = cue_hits(text, REFLECTION_CUES, low) - cue_hits(text, BACKTRACKING_CUES, low)
    return F.element_at(F.array(F.lit("backtracking"), F.lit("other"), F.lit("reflection")), F.signum(d).cast("int") + 2)


def cue_rationale(text) -> Column:
    return F.element_at(F.array(F.lit(RATIONALE_HIT), F.lit(RATIONALE_MISS)), (cue_label(text) == "other").cast("int") + 1)


def sql_cue_label(col: str) -> str:
    """The same rule as a DuckDB expression (used by the oracle SQL)."""

    def hits(ps):
        return " + ".join(f"(coalesce(regexp_matches({col}, '{portable(p).replace(chr(39), chr(39) * 2)}'), false))::INT" for p in ps)

    r, b = f"({hits(REFLECTION_CUES)})", f"({hits(BACKTRACKING_CUES)})"
    return f"CASE WHEN {r} > {b} THEN 'reflection' WHEN {b} > {r} THEN 'backtracking' ELSE 'other' END"
