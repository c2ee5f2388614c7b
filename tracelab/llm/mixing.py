"""Mixing sources to target weights by hash-threshold histograms.

Every source's target is met by whole copies of the source plus the documents
whose hash lies below a threshold.  The threshold comes from histograms of
words by source and leading hash bits: the bucket in which the running sum
passes the budget is refined by the next bits, the others are settled.  Rows
are only aggregated and filtered, never sorted.

Defined cases: a null text has size 0; null doc_ids are told apart by their
text; rows equal in doc_id are taken or left together; a null source is a
source of its own, after the others; sources without words have target 0; an
empty table gives an empty result; other columns pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import WORD, few, stash, words_of

LEVEL_BITS, LEVELS = 12, 3
HASH_BITS = LEVEL_BITS * LEVELS
#: Weights of the sources by code point, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)


def text_size() -> Column:
    return F.size(words_of(F.col("text"))).cast("long")


def row_hash() -> Column:
    """36 bits of the MD5 digest of the doc_id (of the text where that is null)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, size) rows -> (source, source_size, target): shares by weight, at
    most ``cap`` times the source; what is above is dealt to the others.

    Windows run over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    # By rising cap for a unit of weight: a source is capped if its share of what those before leave is above its cap.
    order = Window.orderBy(F.col("source_size") / F.col("w"), "pos")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("left", F.sum("source_size").over(every) - cap * before).withColumn("among", F.sum("w").over(rest))
    per = per.withColumn("capped", F.col("left") * F.col("w") > cap * F.col("source_size") * F.col("among"))
    open_ = F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "pos", "left", "among"))
    per = per.withColumn("first", F.min(open_).over(every))
    share = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.among")
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return per.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (source, size, h) and ``wanted`` (source, source_size, target) ->
    per source the number of whole copies and the hash threshold of one more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    state = wanted.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = stash(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("n", F.lit(0).cast("long")), "mix-state")
    for level in range(LEVELS):
        s = few(state.select(F.col("source").alias("s"), "prefix"))
        bits = HASH_BITS - LEVEL_BITS * level
        inside = rows.join(s, rows["source"].eqNullSafe(s["s"])).where(F.shiftright("h", bits) == F.col("prefix"))
        bucket = F.shiftright("h", bits - LEVEL_BITS)
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")).alias("upto")
        hist = hist.select(F.col("source").alias("s"), "bucket", "words", upto)
        edge = (
            hist.join(few(state), F.col("s").eqNullSafe(F.col("source")))
            .where(F.col("below") + F.col("upto") > F.col("budget"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", (F.col("below") + F.col("upto") - F.col("words")).alias("below"), "words")).alias("e"))
        )
        state = stash(
            state.select("source", "source_size", "target", "copies", "budget")
            .join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(
                "source", "source_size", "target", "copies", "budget",
                F.coalesce("e.bucket", F.lit(0)).alias("prefix"), F.coalesce("e.below", F.lit(0)).alias("below"), F.coalesce("e.words", F.lit(0)).alias("n"),
            ),
            "mix-state",
        )
    nearer = (F.col("below") + F.col("n") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("source", "source_size", "target", "copies", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    s = few(limits.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"), F.col("threshold").alias("mix_threshold")))
    return rows.join(s, rows["source"].eqNullSafe(s["mix_source"]))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of every row, stashed, and the limits by source."""
    rows = stash(docs.select("doc_id", "source", text_size().alias("size"), row_hash().alias("h")), "mix-rows")
    return rows, stash(thresholds(rows, stash(targets(rows, weights, cap), "mix-targets")), "mix-limits")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document row."""
    rows, limits = plan(docs, weights, cap)
    times = F.col("mix_copies") + F.when(F.col("h") < F.col("mix_threshold"), 1).otherwise(0)
    return _joined(rows, limits).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * times).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken."""
    _, limits = plan(docs, weights, cap)
    # The row travels as one column, so no name of the documents' can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), "source", row_hash().alias("h"))
    times = (F.col("mix_copies") + F.when(F.col("h") < F.col("mix_threshold"), 1).otherwise(0)).cast("int")
    copies = F.explode(F.array_repeat(F.lit(1), times)).alias("copy")
    return _joined(rows, limits).select("whole", copies).select("whole.*")


MIXTURE_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents
),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1]::BIGINT AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM rows GROUP BY source
),
cuts AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(w) OVER (ORDER BY source_size / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS among
  FROM per
),
share AS (
  SELECT *, rest * w > 3 * source_size * among AS capped FROM cuts
),
level AS (
  SELECT arg_min(rest, (source_size / w, pos)) AS rest1, arg_min(among, (source_size / w, pos)) AS among1 FROM share WHERE NOT capped
),
wanted AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * rest1)::DOUBLE / among1 END AS target FROM share LEFT JOIN level ON true
),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS copies FROM wanted
),
steps AS (
  SELECT source, h, sum(size)::BIGINT AS n, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM rows GROUP BY source, h
),
edge AS (
  SELECT s.source, arg_min(CASE WHEN s.upto - (b.target - b.copies * b.source_size) < (b.target - b.copies * b.source_size) - (s.upto - s.n) THEN s.h + 1 ELSE s.h END, s.h) AS threshold
  FROM steps s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  WHERE s.upto > b.target - b.copies * b.source_size GROUP BY s.source
)
SELECT r.doc_id, r.size, b.source_size, b.target, r.size * (b.copies + CASE WHEN r.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN edge e ON r.source IS NOT DISTINCT FROM e.source
"""
