"""Quality classifier by importance resampling.

Hashed one- and two-word features; a bag-of-features model of the target
texts and one of all texts; a text's weight is the ratio of its likelihoods.
Adding Gumbel noise to the log ratios and taking the k largest samples k texts
without replacement in proportion to the weights.

The target model is fitted on at most ``MAX_TARGETS`` labelled texts; the raw
model, the weights and the sample cover all texts.

Defined cases: a null or empty text has no features and log ratio 0; without
labels every text is its own target (all ratios 0) and all are sampled; rows
equal in doc_id and text have the same noise and are taken or left together;
ties of the noisy score go together, so a tie at the cut samples more than the
share; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import stash, text_bytes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_TARGETS = 20_000
SMOOTHING = 1.0
CACHE_WORDS = 300_000
HISTOGRAM = 4096


def features(data: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = zlib.crc32(w)
    one = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    pairs = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), pairs])
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def feature_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (t binary, is_target boolean) -> (bucket, n_raw, n_target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, cache = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            for x, good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counted = np.bincount(features(x.as_buffer().to_pybytes(), cache), minlength=BUCKETS)
                raw += counted
                if good:
                    target += counted
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "n_raw", "n_target"])

    each = docs.mapInArrow(run, "bucket int, n_raw long, n_target long")
    return each.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: pd.DataFrame) -> np.ndarray:
    """log(target model / raw model) by bucket."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["n_raw"], counts["n_target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def target_ids(labels: DataFrame, limit: int = MAX_TARGETS) -> DataFrame:
    """At most ``limit`` doc_ids labelled as good, by hash."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def kth_largest(scores: DataFrame, k: int) -> float | None:
    """The kth largest value of column ``score`` by ever finer histograms: the
    driver sees ``HISTOGRAM`` counts a round, whatever the number of rows."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).first()
    if not ends.n or k <= 0:
        return None
    if k >= ends.n:
        return ends.lo
    lo, hi = ends.lo, ends.hi
    while lo < hi:
        width = (hi - lo) / HISTOGRAM
        if lo + width == lo or lo + width * 1.5 >= hi and width == 0:
            break
        cell = F.least(F.floor((F.col("score") - lo) / width), F.lit(HISTOGRAM - 1))
        inside = scores.where((F.col("score") >= lo) & (F.col("score") <= hi))
        cells = {r.c: r for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
        above = scores.where(F.col("score") > hi).count()
        for c in sorted(cells, reverse=True):
            if above + cells[c].n >= k:
                if (lo, hi) == (cells[c].lo, cells[c].hi):
                    return lo
                lo, hi = cells[c].lo, cells[c].hi
                break
            above += cells[c].n
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, max_targets: int = MAX_TARGETS) -> DataFrame:
    """(doc_id, n_features, log_ratio, score, sampled) of every row.

    ``share`` of the rows is sampled; by default the share of good ones among the labelled.
    """
    spark = docs.sparkSession
    targets = stash(target_ids(labels, max_targets), "resample-targets")
    marked = docs.select("doc_id", "text").join(F.broadcast(targets.withColumn("is_target", F.lit(True))), "doc_id", "left")
    counts = feature_counts(marked.select(text_bytes().alias("t"), F.coalesce("is_target", F.lit(False)).alias("is_target")))
    ratios = spark.sparkContext.broadcast(log_ratios(counts.toPandas()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            at = [features(x.as_buffer().to_pybytes(), cache) for x in b.column(1)]
            n = pa.array([len(x) for x in at], pa.int64())
            ratio = pa.array([float(ratios.value[x].sum()) for x in at], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, ratio, b.column(2)], names=["doc_id", "n_features", "log_ratio", "u"])

    # Uniform in (0, 1) from 52 bits of a hash of the row.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12) + F.lit(0.5)) / F.lit(2.0**52)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"), u.alias("u"))
    weighed = rows.mapInArrow(run, "doc_id long, n_features long, log_ratio double, u double")
    scores = stash(weighed.withColumn("score", F.col("log_ratio") - F.log(-F.log("u"))).drop("u"), "resample-scores")
    if share is None:
        got = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double")).alias("s")).first()
        share = 1.0 if got.s is None else got.s
    least = kth_largest(scores.select("score"), round(share * scores.count()))
    return scores.withColumn("sampled", F.lit(False) if least is None else F.col("score") >= F.lit(least))
