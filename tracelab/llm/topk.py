"""Exact top-k search by a vector-approximation file.

Vectors become integers floor(scale * x).  The file holds each distinct vector
once, with the smallest ids that have it and one byte per component: the number
of its cell, of equal-width cells between the smallest and largest component.

A first pass reads the cells only.  For every query they give bounds of each
inner product; a task carries the kth largest lower bound from batch to batch
and keeps the vectors whose upper bound reaches it.  The kth lower bound over
all tasks settles which candidates are left, and only for these are the exact
vectors read, in order of their bounds until no remaining one reaches the kth
exact score.  Queries are shipped in blocks of at most ``QUERY_BYTES``; the
cells are read once a block.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part, nor do candidates of another length than the query;
rows that share a query's id are not its candidates, and an id with several
rows is one query with its smallest vector; ties go to smaller ids, repeated
candidates rank each; an empty vector scores 0 with other empty ones; scores
beyond a long saturate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import few, shared_path, stash

SCALE = 256
CELLS = 256  # a cell number is one byte
QUERY_BYTES = 32 << 20  # of the queries that go to every task at a time
AT_ONCE = 1024  # vectors by queries compared at a time
PRUNE = 1 << 20  # candidates a task holds before it looks again which are left
LONG = np.iinfo(np.int64)


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>): whole-valued components, unfit rows left out."""

    def whole(x: Column) -> Column:
        wide = F.lit(scale) * x.cast("double")  # beyond 2^53 a double is whole already
        return F.when(F.abs(wide) < 2.0**53, F.floor(wide).cast("double")).otherwise(wide)

    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(F.lit(scale) * x.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(at, at[1:], strict=False)]


def va_file(vectors: DataFrame, k: int, cells: int = CELLS) -> tuple[DataFrame, DataFrame, float, float]:
    """Write the file by distinct vector, (uid, v, ids) and (uid, n, only, cells
    binary), and give the ends of its components.  ``ids`` are the k + 1 smallest ids with how
    many rows each has (enough for k candidates beside a query's own rows);
    ``only`` is the id where there is no other."""
    each = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("times"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "times")))
    distinct = each.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(ids.alias("ids"))
    distinct = stash(distinct.withColumn("uid", F.monotonically_increasing_id()), "va-vectors")
    ends = distinct.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    lo, hi = ends.lo or 0.0, ends.hi or 0.0
    width = max((hi - lo) / cells, 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column(1))
            cell = [np.clip((x - lo) / width, 0, cells - 1).astype(np.uint8).tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in v], pa.int32()), b.column(2), pa.array(cell, pa.binary())], names=["uid", "n", "only", "cells"])

    only = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"])
    cell_rows = distinct.select("uid", "v", only.alias("only")).mapInArrow(run, "uid long, n int, only long, cells binary")
    # The cells lie in a table of their own, so that the first pass reads nothing else.
    return distinct, stash(cell_rows, "va-cells"), lo, hi


def _exact(q: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products in whole numbers, saturated to long."""
    if not rows.shape[1]:
        return [0] * len(rows)
    if np.abs(q).max() * np.abs(rows).max() * rows.shape[1] < 2.0**53:
        return (rows @ q).astype(np.int64).tolist()
    qi = [int(x) for x in q]
    return [min(max(sum(a * int(b) for a, b in zip(qi, r, strict=True)), LONG.min), LONG.max) for r in rows]


def _bounded(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], lo: float, hi: float, cells: int, k: int) -> Iterator[pa.RecordBatch]:
    """(uid, n, only, cells) -> (query_id, uid, low, high): the vectors whose
    upper bound reaches the kth largest lower bound that the task has seen."""
    width = max((hi - lo) / cells, 1e-300)
    kept: list[tuple[np.ndarray, ...]] = []
    floors = {n: np.full((k, len(ids)), -np.inf) for n, (ids, _) in queries.items()}

    def left() -> list[tuple[np.ndarray, ...]]:
        out = []
        for n, j, uid, low, high in kept:
            ok = high >= floors[n].min(0)[j]
            out.append((n, j[ok], uid[ok], low[ok], high[ok]))
        return out

    held = 0
    for b in batches:
        lengths = b.column(1).to_numpy()
        for n, (qids, q) in queries.items():
            at = np.flatnonzero(lengths == n)
            for s in range(0, len(at), AT_ONCE):
                part = b.take(pa.array(at[s : s + AT_ONCE]))
                uid = part.column(0).to_numpy()
                only = part.column(2).fill_null(LONG.min).to_numpy()
                sole = part.column(2).is_valid().to_numpy(zero_copy_only=False)
                cell = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(uid), n).astype(np.float32)
                for t in range(0, len(qids), AT_ONCE):
                    ask = q[t : t + AT_ONCE]
                    sums, sizes = ask.sum(1), np.abs(ask).sum(1)
                    # float32 products of cells, and the steps to a cell's ends; slack covers the rounding
                    base = (cell @ ask.astype(np.float32).T) * width + lo * sums
                    slack = sizes * (2.0**-20 * (n + 4) * cells * width + 1e-9 * (max(abs(lo), abs(hi)) + width)) + 1e-9
                    low = base + (width * np.minimum(ask, 0).sum(1) - slack)
                    high = base + (width * np.maximum(ask, 0).sum(1) + slack)
                    own = sole[:, None] & (only[:, None] == qids[None, t : t + AT_ONCE])
                    low[own] = high[own] = -np.inf
                    top = np.concatenate([floors[n][:, t : t + AT_ONCE], low])
                    floors[n][:, t : t + AT_ONCE] = np.partition(top, -k, axis=0)[-k:]
                    i, j = np.nonzero((high >= floors[n][:, t : t + AT_ONCE].min(0)) & ~own)
                    kept.append((n, j + t, uid[i], low[i, j], high[i, j]))
                    held += len(i)
                if held > PRUNE:
                    kept = left()
                    held = sum(len(x[1]) for x in kept)
                    kept = [x for x in kept if len(x[1])]
    for n, j, uid, low, high in left():
        yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][j]), pa.array(uid), pa.array(low), pa.array(high)], names=["query_id", "uid", "low", "high"])


def _settled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, q, high, v, ids), by query and falling upper bound -> the
    (query_id, vec_id, score) of the k best rows: vectors are compared until the
    kth score is above the next bound."""
    now: int | None = None
    found: list[tuple[int, int]] = []
    done: list[tuple[int, int, int]] = []

    def close() -> None:
        if now is not None:
            done.extend((now, i, -s) for s, i in found)

    for b in batches:
        high = b.column(2).to_numpy()
        for r, (qid, q, v) in enumerate(zip(b.column(0).to_pylist(), _rows(b.column(1)), _rows(b.column(3)), strict=True)):
            if qid != now:
                close()
                now, found = qid, []
            if len(found) == k and high[r] < -found[-1][0]:
                continue  # nor can any later one of this query
            score = _exact(q, v[None])[0]
            mine = [(-score, x["vec_id"]) for x in b.column(4)[r].as_py() if x["vec_id"] != qid for _ in range(min(k, x["times"]))]
            found = sorted([*found, *mine])[:k]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["query_id", "vec_id", "score"])
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int = CELLS, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, v) -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    distinct, cell_rows, lo, hi = va_file(vectors, k, cells)
    near = shared_path(spark, "va-near")
    asked = stash(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "va-queries")
    size = asked.agg(F.sum(F.lit(8) * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = stash(asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "va-blocks")
    schema = "query_id long, uid long, low double, high double"
    spark.createDataFrame([], schema).write.parquet(near)
    for b in range(blocks):  # about ``block_bytes`` each: what goes to every task is bounded
        rows = dealt.where(F.col("b") == b).select("vec_id", "v").toArrow()
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        vs, ids = _rows(rows["v"].combine_chunks()), rows["vec_id"].to_numpy()
        sizes = np.array([len(v) for v in vs])
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            by_length[n] = ids[of], np.array([vs[i] for i in of], np.float64).reshape(len(of), n)
        shared = spark.sparkContext.broadcast(by_length)
        cell_rows.mapInArrow(lambda batches, shared=shared: _bounded(batches, shared.value, lo, hi, cells, k), schema).write.mode("append").parquet(near)
        shared.destroy()
    candidates = spark.read.schema(schema).parquet(near)
    # The kth lower bound over all tasks; a query with fewer vectors keeps all of them.
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc()))
    floors = candidates.select("query_id", "low", kth.alias("r")).where(F.col("r") == k).select("query_id", F.col("low").alias("floor"))
    wanted = candidates.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query_id", "uid", "high")
    wanted = few(stash(wanted, "va-wanted"))
    read = distinct.join(wanted, "uid").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    ordered = read.select("query_id", "q", "high", "v", "ids").repartition("query_id").sortWithinPartitions("query_id", F.col("high").desc())
    exact = ordered.mapInArrow(lambda batches: _settled(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return exact.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")


SEARCH_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
