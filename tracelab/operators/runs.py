"""Labelling runs, resumable results and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions.cues import cue_label, cue_rationale
from tracelab.functions.text import answer_match, extract_final_answer, is_blank, py_strip, regex_quote

# Persisted step-label record (15 fields).
STEP_LABEL_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("step_id", T.IntegerType()),
        T.StructField("step_text", T.StringType()),
        T.StructField("step_start_char", T.IntegerType()),
        T.StructField("step_end_char", T.IntegerType()),
        T.StructField("delimiter_start_char", T.IntegerType()),
        T.StructField("delimiter_end_char", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_rationale", T.StringType()),
        T.StructField("label_source", T.StringType()),
        T.StructField("judge_model", T.StringType()),
    ]
)

# Persisted intervention-run record.
INTERVENTION_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("question", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("predicted_answer", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("reflection_steps", T.IntegerType()),
        T.StructField("backtracking_steps", T.IntegerType()),
        T.StructField("other_steps", T.IntegerType()),
        T.StructField("response", T.StringType()),
    ]
)

# Response cache record.
RESPONSE_CACHE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_template", T.StringType()),
        T.StructField("max_new_tokens", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_p", T.DoubleType()),
    ]
)

JUDGES = ("heuristic",)


def _label_inputs() -> list[Column]:
    """The columns of a label record that come from a step."""
    return [
        F.col("sample_id").cast("string"),
        *(F.col(c) for c in ("question", "response", "full_text", "reference_answer")),
        F.col("step_id").cast("int"),
        F.col("step_text"),
        F.col("step_start").cast("int").alias("step_start_char"),
        F.col("step_end").cast("int").alias("step_end_char"),
        F.col("delim_start").cast("int").alias("delimiter_start_char"),
        F.col("delim_end").cast("int").alias("delimiter_end_char"),
    ]


def label_steps(steps: DataFrame, judge: str = "heuristic", judge_fn=None, judge_model: str | None = None) -> DataFrame:
    """Label every step.  ``heuristic`` runs the cue rule as column
    expressions; any other judge is a user function applied per Arrow batch
    (``judge_fn(pandas.DataFrame) -> pandas.DataFrame[label, rationale]``
    over question, response, step_text, previous_step, next_step; the
    neighbours come from the steps if they carry them, else by a window).

    ``steps`` has sample_id, question, response, full_text, reference_answer,
    step_id, step_start, step_end, delim_start, delim_end, step_text.
    """
    base = steps.select(*_label_inputs())
    if judge == "heuristic":
        return base.select(
            "*",
            cue_label("step_text").alias("label"),
            cue_rationale("step_text").alias("label_rationale"),
            F.lit("heuristic").alias("label_source"),
            F.lit(None).cast("string").alias("judge_model"),
        )
    if judge_fn is None:
        raise ValueError(f"Unsupported judge: {judge}")
    if "previous_step" in steps.columns:
        ctx = steps.select(*[F.col(c) for c in ("previous_step", "next_step")], *_label_inputs())
    else:
        w = Window.partitionBy("sample_id").orderBy("step_id")
        ctx = base.select("*", F.lag("step_text").over(w).alias("previous_step"), F.lead("step_text").over(w).alias("next_step"))
    out_schema = T.StructType(list(base.schema.fields) + [f for f in STEP_LABEL_SCHEMA.fields if f.name in ("label", "label_rationale", "label_source", "judge_model")])

    base_cols = [f.name for f in base.schema.fields]  # no DataFrame inside the task closure

    def run(batches):
        for pdf in batches:
            got = judge_fn(pdf[["question", "response", "step_text", "previous_step", "next_step"]])
            res = pdf[base_cols].copy()
            res["label"] = got["label"].str.lower().values
            bad = ~res["label"].isin(["reflection", "backtracking", "other"])
            if bad.any():
                row = pdf[bad.values].iloc[0]
                raise ValueError(f"judge failed for sample {row['sample_id']} step {row['step_id']}")
            res["label_rationale"] = got["rationale"].values
            res["label_source"] = judge
            res["judge_model"] = judge_model
            yield res

    return ctx.mapInPandas(run, out_schema)


def resume_pending(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Rows whose key is not yet written (anti join)."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume_done(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Rows already completed (semi join)."""
    return todo.join(done.select(*keys), list(keys), "left_semi")


def with_cached_responses(samples: DataFrame, cache: DataFrame, order_col: str, prefetched: DataFrame | None = None, prefetch_order: str | None = None) -> DataFrame:
    """Cached question/response/reference answer override the sample.

    The last cache record per id wins (by ``order_col``), over the first
    prefetched record per id; both questions non-empty and different raise.
    """

    def pick(df, col, last):
        w = Window.partitionBy("sample_id").orderBy(F.col(col).desc() if last else F.col(col).asc())
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", col)

    c = pick(cache, order_col, True).select(
        "sample_id", F.col("question").alias("_cq"), F.col("response").alias("_cr"), F.col("reference_answer").alias("_ca"), F.lit(1).alias("_cached")
    )
    if prefetched is not None:
        p = pick(prefetched, prefetch_order, False).select(
            "sample_id", F.col("question").alias("_pq"), F.col("response").alias("_pr"), F.col("reference_answer").alias("_pa"), F.lit(1).alias("_pf")
        )
        c = c.join(p, "sample_id", "full_outer").select(
            "sample_id",
            F.when(F.col("_cached").isNotNull(), F.col("_cq")).otherwise(F.col("_pq")).alias("_cq"),
            F.when(F.col("_cached").isNotNull(), F.col("_cr")).otherwise(F.col("_pr")).alias("_cr"),
            F.when(F.col("_cached").isNotNull(), F.col("_ca")).otherwise(F.col("_pa")).alias("_ca"),
            F.coalesce("_cached", "_pf").alias("_cached"),
        )
    j = samples.join(c, "sample_id", "left")
    # the check sits in a filter so the optimizer cannot prune it away
    clash = (
        F.col("_cached").isNotNull()
        & (F.coalesce(F.col("question"), F.lit("")) != "")
        & (F.coalesce(F.col("_cq"), F.lit("")) != "")
        & (F.col("question") != F.col("_cq"))
    )
    err = F.raise_error(F.concat(F.lit("cached question differs for sample "), F.col("sample_id").cast("string")))
    return j.filter(F.when(clash, err).otherwise(F.lit(True))).select(
        "sample_id",
        F.when(F.col("_cached").isNotNull() & (F.coalesce(F.col("_cq"), F.lit("")) != ""), F.col("_cq"))
        .otherwise(F.col("question"))
        .alias("question"),
        F.when(F.col("_cached").isNotNull(), F.col("_cr")).otherwise(F.col("response")).alias("response"),
        F.when(F.col("_cached").isNotNull(), F.col("_ca")).otherwise(F.col("reference_answer")).alias("reference_answer"),
        F.col("_cached").isNotNull().alias("from_cache"),
    )


def parse_conditions(spec: str) -> list[tuple[str, float]]:
    """``"negative:1.0,vanilla:0.0,positive:-1.0"`` -> [(name, alpha)]."""
    out = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        name, _, alpha = part.partition(":")
        if not name or not alpha:
            raise ValueError(f"bad condition {part!r}")
        out.append((name.strip(), float(alpha)))
    if not out:
        raise ValueError("no conditions")
    return out


def cross_conditions(samples: DataFrame, spec: str, question_col: str = "question") -> DataFrame:
    """Every sample with a non-blank question under every condition.

    The condition list is a literal array exploded per row (a generator,
    no join)."""
    conds = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(a).alias("alpha")) for n, a in parse_conditions(spec)])
    return samples.filter(~is_blank(question_col)).select("*", F.explode(conds).alias("_c")).select(
        *samples.columns, F.col("_c.condition").alias("condition"), F.col("_c.alpha").alias("alpha")
    )


STEP_COUNTS = ("reflection_steps", "backtracking_steps", "other_steps")


def step_label_counts(df: DataFrame, text_col: str, delim: str = "\n\n", total: str | None = None) -> DataFrame:
    """A10: the number of steps of each cue label in every row's text, beside
    the row (``total``: a column for their sum).  Cut and labelled in the row
    (the steps of X1), so nothing is exploded or grouped.  A null text has none."""
    from tracelab.operators.segment import evaluate_once

    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), regex_quote(delim), -1)
    steps = F.filter(F.transform(parts, lambda x: py_strip(x)), lambda x: x != "")
    both = F.transform(steps, lambda x: F.struct(x.alias("text"), F.lower(x).alias("low")))
    counted = evaluate_once(df.select("*", F.transform(both, lambda x: cue_label(x["text"], x["low"])).alias("_labels")))

    def count(label: str) -> Column:
        return F.size(F.filter("_labels", lambda x: x == label)).cast("long")

    of = [count(name.removesuffix("_steps")).alias(name) for name in STEP_COUNTS]
    every = [F.size("_labels").cast("long").alias(total)] if total else []
    return counted.select(*df.columns, *of, *every)


def intervention_summary(runs: DataFrame) -> DataFrame:
    """Per condition mean step counts, totals, scored runs, accuracy
    (correct / scored, null when nothing was scored)."""
    return runs.groupBy("condition").agg(
        F.avg("reflection_steps").alias("mean_reflection_steps"),
        F.avg("backtracking_steps").alias("mean_backtracking_steps"),
        F.avg("other_steps").alias("mean_other_steps"),
        F.try_divide(F.count_if(F.col("is_correct")), F.count("is_correct")).alias("accuracy"),
        F.count(F.lit(1)).alias("num_samples"),
        F.count("is_correct").alias("num_scored_samples"),
    )


def score_runs(runs: DataFrame) -> DataFrame:
    """P7 + P9 on generated responses: predicted answer and correctness."""
    from tracelab.operators.segment import evaluate_once

    scored = evaluate_once(runs.withColumn("predicted_answer", extract_final_answer("response")))
    return scored.withColumn("is_correct", answer_match("predicted_answer", "reference_answer"))


def perplexity(losses: DataFrame, by=(), loss_col: str = "loss", tokens_col: str = "n_tokens") -> DataFrame:
    """exp(Σ loss·n / Σ n) with n = tokens - 1; texts with fewer than 2
    tokens are skipped; no counted token -> +inf."""
    by = [by] if isinstance(by, str) else list(by)
    n = F.col(tokens_col) - 1
    use = F.col(tokens_col) >= 2
    num = F.sum(F.when(use, F.col(loss_col) * n))
    den = F.sum(F.when(use, n))
    ppl = F.when(F.coalesce(den, F.lit(0)) > 0, F.exp(num / den)).otherwise(F.lit(float("inf")))
    aggs = [ppl.alias("perplexity"), F.coalesce(den, F.lit(0)).cast("long").alias("n_tokens")]
    return losses.groupBy(*by).agg(*aggs) if by else losses.agg(*aggs)


def perplexity_report(losses: DataFrame, key: str, base_col: str = "loss", patched_col: str = "patched_loss", tokens_col: str = "n_tokens", limit_pct: float = 5.0) -> DataFrame:
    """Perplexity by both losses of the same texts in one aggregate;
    increase % = (patched - base) / base · 100, passed when below the limit;
    ``all_passed`` over every key (window over the report rows)."""
    use = F.col(tokens_col) >= 2
    n = F.when(use, F.col(tokens_col) - 1)
    den = F.sum(n)

    def ppl(loss_col: str) -> Column:
        return F.when(F.coalesce(den, F.lit(0)) > 0, F.exp(F.sum(F.col(loss_col) * n) / den)).otherwise(F.lit(float("inf")))

    j = losses.groupBy(key).agg(ppl(base_col).alias("ppl_original"), ppl(patched_col).alias("ppl_with_sae"))
    inc = (F.col("ppl_with_sae") - F.col("ppl_original")) / F.col("ppl_original") * 100
    return j.select(
        key,
        "ppl_original",
        "ppl_with_sae",
        inc.alias("ppl_increase_pct"),
        (inc < limit_pct).alias("passed"),
    ).withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy()))


def eval_texts(df: DataFrame, order_col: str, min_chars: int | None = None, max_samples: int | None = None, fields=("text", "question", "problem")) -> DataFrame:
    """Evaluation texts: the first non-empty of text / question / problem;
    ``min_chars`` keeps only longer texts (the wikitext rule is 50); the first
    ``max_samples`` by ``order_col``."""
    present = [f for f in fields if f in df.columns]
    t = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in present])
    out = df.select(order_col, t.alias("text")).filter(F.col("text").isNotNull())
    if min_chars is not None:
        out = out.filter(F.length("text") > min_chars)
    if max_samples is not None:
        out = out.orderBy(order_col).limit(max_samples)
    return out
