"""Sampling, mixing, shuffling, batching.

Randomness is a seeded hash of a row key (never ``rand()``), so a row's draw
does not depend on partitioning and survives task retries.  Global indexes
(batches, interleaving, cumulative weights) come from range buckets with fixed
bounds: one small aggregate (a row per bucket) fixes each bucket's offset, and
every row adds its index inside the bucket — no single-task window.  A hash of
the whole row ends every order, so repeated keys spread and ties are fixed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_uniform(key_cols, seed: int) -> Column:
    """Uniform in [0, 1) from md5(key || seed) (same digits in DuckDB)."""
    keys = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key_cols]
    h = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample_n(df: DataFrame, n: int, seed: int, key_col: str, by: str = "split") -> DataFrame:
    """K4: exactly n rows per group (whole group when it is smaller),
    deterministic for a seed; the group's name enters the hash, so groups
    draw independently.  ``row_number <= n`` is planned with a partial
    per-task limit, so a group holding a third of the data ships at most n
    rows per task."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.col(by).cast("string"), F.lit(str(seed)))), F.col(key_col))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


#: Rows whose keys give the bounds of range buckets: this many at least, and for each bucket.
BOUND_SAMPLE, BOUND_ROWS = 4096, 64


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row (columns that can be hashed): the last order key
    of rows that tie, so that their order is the same in every run and a key
    that many rows share still falls into several buckets."""
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def range_buckets(df: DataFrame, order_cols: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Add an int column that rises with ``order_cols``: how many of a list of
    bounds a row is not below.  The bounds are constants of the plan (quantiles
    of a sample of the keys, chosen by their hash, so partial samples merge and
    every run draws the same), so every job that uses the column sees the same
    buckets, however it partitions.  Callers end ``order_cols`` with the
    ``row_hash`` so that a repeated key does not fill a bucket by itself."""
    types = dict(df.dtypes)
    wanted = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(*order_cols).orderBy(F.xxhash64(*order_cols)).limit(max(BOUND_SAMPLE, BOUND_ROWS * wanted))
    rows = sample.distinct().orderBy(*order_cols).collect()
    wanted = min(wanted, len(rows))
    if wanted < 2:
        return df.withColumn(name, F.lit(0))
    cuts = [rows[len(rows) * i // wanted] for i in range(1, wanted)]
    struct = lambda r: F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order_cols])
    key = F.struct(*[F.col(c).alias(c) for c in order_cols])
    step = max(1, math.isqrt(len(cuts)))  # two levels: every step-th bound, then those between
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[struct(g[0]) for g in groups])
    group = F.size(F.filter(heads, lambda c: c <= key))
    inner = F.array(*[F.array(*[struct(r) for r in g]) for g in groups])
    within = F.size(F.filter(F.get(inner, group - 1), lambda c: c <= key))
    return df.withColumn(name, F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + within))


def partition_index(df: DataFrame, order_cols, name: str = "row_index") -> DataFrame:
    """Dense 0-based global index in ``order_cols`` order.

    Rows fall into range buckets whose bounds are constants; a small aggregate
    counts each bucket, and a row's index is its bucket's offset plus its row
    number inside the bucket.  The driver sees one count a bucket.  Rows that
    tie in ``order_cols`` are ordered by a hash of the whole row (equal rows
    are interchangeable), so reruns agree."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    keys = [*order_cols, "_tie"]
    s = range_buckets(df.withColumn("_tie", row_hash(df)), keys, "_bucket")
    counts = {r["_bucket"]: r["_c"] for r in s.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c")).collect()}
    if not counts:
        return df.withColumn(name, F.lit(None).cast("long"))
    offsets, acc = [], 0
    for i in range(max(counts) + 1):
        offsets.append(acc)
        acc += counts.get(i, 0)
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_bucket"))
    return s.withColumn(name, offset + local).drop("_bucket", "_tie")


def assign_batches(df: DataFrame, batch_size: int, order_cols, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in order, the final
    partial batch kept."""
    idx = partition_index(df, order_cols, "_idx")
    return idx.withColumn(name, F.floor(F.col("_idx") / batch_size).cast("long")).drop("_idx")


def interleave(dfs: dict[str, DataFrame], order_col: str) -> DataFrame:
    """Round-robin over sources; every source contributes min(n_i) rows.
    One index over all sources (ordered by source, then ``order_col``) and one
    count by source, however many there are.
    Output: source, rn (0-based round), original columns (by name)."""
    every = None
    for name, d in dfs.items():
        part = d.withColumn("source", F.lit(name))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    if every is None:
        raise ValueError("no sources to interleave")
    counts = dict.fromkeys(dfs, 0) | {r["source"]: r["count"] for r in every.groupBy("source").count().collect()}
    rounds, first, before = min(counts.values()), [], 0
    for name in sorted(counts, key=lambda n: n.encode()):  # the order of Spark's strings
        first += [F.lit(name), F.lit(before).cast("long")]
        before += counts[name]
    indexed = partition_index(every, ["source", order_col], "rn")
    return indexed.withColumn("rn", F.col("rn") - F.element_at(F.create_map(*first), F.col("source"))).filter(F.col("rn") < rounds)


def mix_sources(reasoning: DataFrame | None, general: DataFrame | None, ratio: float, key_col: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """K5: interleave two sources so that, while both have rows, a draw is
    reasoning with probability ``ratio``; when one runs out the other
    continues.  Without a cap every row of both appears.  Ratio >= 1 (<= 0)
    leaves the general (reasoning) source out of the plan entirely.

    Each row gets a position uniform over its source's span
    ``count / weight``; ordering by position gives the mixed stream."""
    use_r = reasoning is not None and (general is None or ratio > 0.0)
    use_g = general is not None and (reasoning is None or ratio < 1.0)
    parts = []
    if use_r:
        nr = reasoning.count()
        w = ratio if use_g else 1.0
        parts.append(reasoning.withColumn("source", F.lit("reasoning")).withColumn("_pos", hash_uniform([key_col, F.lit("r")], seed) * (nr / w)))
    if use_g:
        ng = general.count()
        w = (1.0 - ratio) if use_r else 1.0
        parts.append(general.withColumn("source", F.lit("general")).withColumn("_pos", hash_uniform([key_col, F.lit("g")], seed) * (ng / w)))
    if not parts:
        raise ValueError("At least one reasoning or general dataset must be provided")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = out.orderBy("_pos", "source", key_col)
    if n is not None:
        out = out.limit(n)
    return out.withColumnRenamed("_pos", "mix_position")


def global_shuffle(df: DataFrame, seed: int, key_cols, n_partitions: int | None = None) -> DataFrame:
    """K7: random row order: hash-partition on a seeded key, then sort inside
    each partition by it (no global sort needed for a random order).  Without
    ``n_partitions`` the session's shuffle partitions hold."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    k = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    keyed = df.withColumn("_shuffle_key", k)
    dealt = keyed.repartition(n_partitions, "_shuffle_key") if n_partitions else keyed.repartition("_shuffle_key")
    return dealt.sortWithinPartitions("_shuffle_key").drop("_shuffle_key")


def limit_rows(df: DataFrame, n: int, order_cols) -> DataFrame:
    """K8: first n rows by an explicit order (top-n, no global sort)."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    return df.orderBy(*order_cols).limit(n)


def repeat_epochs(df: DataFrame, n: int, seed: int, key_cols) -> DataFrame:
    """K9: n passes over the data, each reshuffled (epoch enters the key).
    Epochs come from a per-row generator (no join)."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    rep = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("epoch"))
    return global_shuffle(rep, seed, ["epoch", *key_cols])


#: Rows of a bucket of weighted draws, buckets at most, draws of one group.
WEIGHT_ROWS, WEIGHT_BUCKETS, GROUP_DRAWS = 50_000, 4096, 100_000


def sample_by_weight(rows: DataFrame, weight_col: str, key_col: str, n: int, seed: int, buckets: int | None = None) -> DataFrame:
    """N draws with replacement, probability proportional to the weight.

    Rows are dealt to buckets by a hash of their key; the driver gets one sum
    of weights a bucket.  Draw i lands at u_i = uniform(seed, i) · total, in the
    bucket whose share of [0, total) holds it and at a place inside that
    bucket's weights, laid end to end by key.  Bucket and draws meet in one
    group, where the row is looked up; a bucket that many draws hit (one heavy
    row) is copied to several groups, each with a part of its draws.  No weight
    is summed over all rows in order, and rows are shuffled once, by bucket.
    Rows without a positive finite weight are never drawn; those that share a
    key are told apart by their weights only.
    Output: draw (0..n-1), key."""
    spark = rows.sparkSession
    ktype = dict(rows.dtypes)[key_col]
    schema = f"draw long, {key_col} {ktype}"
    weight = F.col(weight_col).cast("double")
    usable = rows.filter((weight > 0) & (weight < float("inf"))).select(key_col, weight.alias("_w"))
    if buckets is None:
        buckets = max(1, min(WEIGHT_BUCKETS, -(-usable.count() // WEIGHT_ROWS)))
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.lit(str(seed)), F.lit("bucket"))), 1, 8), 16, 10).cast("long") % buckets
    dealt = usable.withColumn("_b", bucket.cast("int"))
    share = np.zeros(buckets)
    for r in dealt.groupBy("_b").agg(F.sum("_w").alias("w")).collect():
        share[r["_b"]] = r["w"]
    total = float(share.sum())
    if total <= 0 or n <= 0:
        return spark.createDataFrame([], schema)
    ends = np.cumsum(share)
    copies = 1 + (n * share / total / GROUP_DRAWS).astype(np.int64)
    filled = np.flatnonzero(share > 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("_u").to_numpy() * total
            of = filled[np.minimum(np.searchsorted(ends[filled], at, side="right"), len(filled) - 1)]
            rest = at - (ends[of] - share[of])
            salt = b.column("draw").to_numpy() % copies[of]
            yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array(of.astype(np.int32)), pa.array(salt), pa.array(rest)], names=["draw", "_b", "_salt", "_rest"])

    draws = spark.range(n).select(F.col("id").alias("draw"), hash_uniform([F.col("id")], seed).alias("_u"))
    draws = draws.mapInArrow(place, "draw long, _b int, _salt long, _rest double")
    of_bucket = F.get(F.lit(copies.tolist()), F.col("_b")) - 1
    salted = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), of_bucket.cast("long"))).alias("_salt"))

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(key_col, "ascending"), ("_w", "ascending")])
        upto = np.cumsum(left["_w"].to_numpy())
        at = np.minimum(np.searchsorted(upto, right["_rest"].to_numpy(), side="right"), len(upto) - 1) if len(upto) else np.zeros(0, np.int64)
        return pa.table({"draw": right["draw"], key_col: left[key_col].take(pa.array(at))})

    return salted.groupBy("_b", "_salt").cogroup(draws.groupBy("_b", "_salt")).applyInArrow(pick, schema)


def union_sources(dfs: list, loader=None) -> DataFrame:
    """Union by column name (missing columns null); sources that fail to
    load are skipped with a warning; none left -> error."""
    import warnings

    loaded = []
    for d in dfs:
        try:
            loaded.append(loader(d) if loader else d)
        except Exception as exc:  # noqa: BLE001
            warnings.warn(f"Could not load dataset {d}: {exc}")
    if not loaded:
        raise ValueError("No datasets could be loaded")
    out = loaded[0]
    for d in loaded[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def layer_grid(layers=None, layer_range: str | None = None, layer_step: int | None = None, final_layer: int | None = None) -> list[int]:
    """Layer list (unique, sorted, >= 0) or an inclusive ``start:end[:step]``
    range (step > 0) plus the final layer; both forms or two steps -> error."""
    if layers is not None and layer_range is not None:
        raise ValueError("Use either a layer list or a layer range, not both")
    if layers is not None:
        if isinstance(layers, str):
            items = [p.strip() for p in layers.split(",") if p.strip()]
            vals = [int(p) for p in items]
        else:
            vals = [int(v) for v in layers]
        if any(v < 0 for v in vals):
            raise ValueError("layers must be >= 0")
        out = sorted(set(vals))
        if final_layer is not None:
            out = sorted(set(out) | {int(final_layer)})
        return out
    if layer_range is None:
        return [] if final_layer is None else [int(final_layer)]
    parts = [p.strip() for p in layer_range.split(":")]
    if len(parts) not in (2, 3):
        raise ValueError(f"bad layer range {layer_range!r}")
    start, end = int(parts[0]), int(parts[1])
    if len(parts) == 3:
        if layer_step is not None:
            raise ValueError("layer step given twice")
        step = int(parts[2])
    else:
        step = layer_step if layer_step is not None else 1
    if step <= 0:
        raise ValueError("layer step must be positive")
    if start < 0 or end < start:
        raise ValueError(f"bad layer range {layer_range!r}")
    out = list(range(start, end + 1, step))
    if final_layer is not None:
        out = sorted(set(out) | {int(final_layer)})
    return out


def select_layers(df: DataFrame, layers: list[int], layer_col: str = "layer") -> DataFrame:
    """P15 on data: keep the grid's layers (partition pruning when ``layer``
    is a partition column)."""
    return df.filter(F.col(layer_col).isin(*layers))


def train_curve(metrics: DataFrame, step_col: str, value_cols, interval: int) -> DataFrame:
    """Mean of each metric per log interval of ``interval`` steps
    (steps are 1-based; interval i covers steps i*n+1 .. (i+1)*n)."""
    value_cols = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    iv = F.floor((F.col(step_col) - 1) / interval).cast("long").alias("interval")
    return metrics.groupBy(iv).agg(*[F.avg(c).alias(c) for c in value_cols], F.max(step_col).alias("last_step"))


def best_so_far(curve: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """Running minimum of a curve: inside range buckets, then with the
    least of the buckets before (one number a bucket on the driver)."""
    s = range_buckets(curve, [order_col], "_bucket")  # rows that tie share their running minimum, so they stay together
    least = {r["_bucket"]: r["_m"] for r in s.groupBy("_bucket").agg(F.min(value_col).alias("_m")).collect()}
    before, so_far = [], None
    for i in range(max(least, default=-1) + 1):
        before.append(F.lit(so_far).cast("double"))
        so_far = min((x for x in (so_far, least.get(i)) if x is not None), default=None)
    w = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.get(F.array(*before), F.col("_bucket")) if before else F.lit(None).cast("double")
    return s.withColumn(f"best_{value_col}", F.least(F.min(value_col).over(w), earlier)).drop("_bucket")


def sources_summary(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and the number of data columns."""
    n_cols = len([c for c in df.columns if c != split_col])
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(n_cols).cast("long"))


__all__ = [name for name in dir() if not name.startswith("_") and name != "math"]
