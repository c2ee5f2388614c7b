"""DuckDB SQL fragments for the oracle side (same rules as the Spark code)."""

from __future__ import annotations

from tracelab.functions.text import FINAL_ANSWER_HEADER, LINE_BREAK, NOT_WS, WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def segment_cte(name: str, src: str, ids: list[str], text: str, delim_sql: str, dlen: int, start: str = "0", end: str | None = None, keep: list[str] = ()) -> str:
    """CTE ``name`` with ids, keep, step_id, step_start, step_end, delim_start,
    delim_end, step_text for texts in ``src``."""
    end = end or f"length({text})"
    idl = ", ".join(ids)
    kl = "".join(f", {k}" for k in keep)
    return f"""
{name}_p AS (
  SELECT {idl}{kl}, s0, unnest(parts) AS piece, unnest(range(len(parts))) AS pos, len(parts) AS n
  FROM (SELECT {idl}{kl}, ({start})::BIGINT AS s0,
               string_split(CASE WHEN ({end}) > ({start}) THEN substr({text}, ({start}) + 1, ({end}) - ({start})) ELSE '' END, {delim_sql}) AS parts
        FROM {src} WHERE {text} IS NOT NULL)
),
{name}_q AS (
  SELECT *, s0 + coalesce(sum(length(piece) + {dlen}) OVER (PARTITION BY {idl} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps,
         length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS lw,
         length(piece) - length(regexp_replace(piece, '{WS}+$', '')) AS tw
  FROM {name}_p
),
{name} AS (
  SELECT {idl}{kl}, (row_number() OVER (PARTITION BY {idl} ORDER BY pos) - 1)::BIGINT AS step_id,
         (ps + lw)::BIGINT AS step_start, (ps + length(piece) - tw)::BIGINT AS step_end,
         (CASE WHEN pos < n - 1 THEN ps + length(piece) END)::BIGINT AS delim_start,
         (CASE WHEN pos < n - 1 THEN ps + length(piece) + {dlen} END)::BIGINT AS delim_end,
         substr(piece, lw + 1, length(piece) - lw - tw) AS step_text
  FROM {name}_q WHERE length(piece) > lw
)"""


def tokens_cte(name: str, src: str, ids: list[str], text: str) -> str:
    idl = ", ".join(ids)
    return f"""
{name}_r AS (
  SELECT {idl}, unnest(runs) AS run, unnest(range(len(runs))) AS pos
  FROM (SELECT {idl}, regexp_extract_all({text}, '({WS}+|{NOT_WS}+)', 0) AS runs FROM {src} WHERE {text} IS NOT NULL)
),
{name}_s AS (
  SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY {idl} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
         regexp_matches(run, '^{NOT_WS}') AS is_tok
  FROM {name}_r
),
{name} AS (
  SELECT {idl}, (row_number() OVER (PARTITION BY {idl} ORDER BY pos) - 1)::BIGINT AS token_idx,
         st::BIGINT AS tok_start, (st + length(run))::BIGINT AS tok_end, run AS token
  FROM {name}_s WHERE is_tok
)"""


def final_answer(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({x}, '{LINE_BREAK}'), lambda l: {strip('l')}), lambda l: l <> '')"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"WHEN regexp_matches({x}, '(?is){FINAL_ANSWER_HEADER}.') THEN {strip(f"regexp_extract({x}, '(?is){FINAL_ANSWER_HEADER}(.+)', 1)")} "
        f"ELSE {lines}[-1] END"
    )


def normalize_answer(x: str) -> str:
    return f"nullif(lower({strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")}), '')"


def answer_match(pred: str, ref: str) -> str:
    return f"CASE WHEN {ref} IS NOT NULL AND {ref} <> '' THEN {normalize_answer(pred)} IS NOT DISTINCT FROM {normalize_answer(ref)} END"


# Derived traces of the fixture (see FIXTURES): every line of the trimmed text
# gets a cue prefix chosen by (doc_id*7 + line) % 5, lines joined by a blank
# line, plus a final-answer line.
def traces_cte(name: str = "traces") -> str:
    return f"""
{name} AS (
  SELECT doc_id,
         array_to_string(list_transform(string_split(trim(text), chr(10)), lambda x, i:
             CASE (doc_id * 7 + i - 1) % 5 WHEN 0 THEN 'Wait, let me verify. ' WHEN 1 THEN 'Alternatively, '
                  WHEN 2 THEN 'Wait, instead ' ELSE '' END || x), chr(10) || chr(10))
           || chr(10) || chr(10) || 'Final Answer: ' || (doc_id % 10)::VARCHAR AS response,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10)::VARCHAR END AS reference_answer,
         split_part(trim(text), chr(10), 1) AS question, text
  FROM documents
)"""
