"""Shared helpers for the registered query plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Output floats are rounded to this many digits in both engines.
OUT_DIGITS = 6


def register(name: str, sql: str | None = None):
    """Register a query plan (and its DuckDB oracle when SQL can express it)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, OUT_DIGITS)


def sql_fixture_latents(sparse: bool = False) -> str:
    """DuckDB fragment: the fixture model as a latent table (same rule as
    ``tracelab.operators.sae.fixture_params``)."""
    bias = "-0.6" if sparse else "((i*13) % 11 - 5) / 64.0"
    return f"""
lat AS (
  SELECT i AS latent_id,
         [((i*31 + j*17 + i*j*7) % 257 - 128) / 256.0 FOR j IN range(64)] AS w,
         {bias} AS b
  FROM range(256) t(i)
),
latd AS (
  SELECT latent_id, b,
         [x / greatest(sqrt(list_sum([y*y FOR y IN w])), 1e-12) FOR x IN w] AS wd
  FROM lat
)"""


def sql_fixture_features(sparse: bool = False) -> str:
    """DuckDB fragment: relu(z) for every (embedding, latent) pair and the
    top-8 features of every embedding under the fixture model."""
    return (
        sql_fixture_latents(sparse)
        + """,
z AS (
  SELECT e.vec_id, e.label, l.latent_id,
         greatest(list_dot_product(e.embedding::DOUBLE[], l.w) + l.b, 0) AS v
  FROM embeddings e CROSS JOIN lat l
),
feats AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, latent_id) - 1 AS rnk FROM z
  ) WHERE rnk < 8
)"""
    )


def sql_fixture_residuals() -> str:
    """DuckDB fragment (after the features): decode, per-element residuals
    and per-row sums."""
    return """,
dec AS (
  SELECT vec_id, j, sum(v * w) AS xh FROM (
    SELECT f.vec_id, f.v, unnest(l.wd) AS w, unnest(range(64)) AS j FROM feats f JOIN latd l USING (latent_id)
  ) GROUP BY vec_id, j
),
xe AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
res AS (SELECT xe.vec_id, xe.label, xe.j, xe.x, xe.x - coalesce(dec.xh, 0) AS r FROM xe LEFT JOIN dec USING (vec_id, j)),
rowstats AS (
  SELECT vec_id, label, sum(x) AS x_sum, sum(x * x) AS x_sq, sum(r) AS r_sum, sum(r * r) AS r_sq FROM res GROUP BY vec_id, label
),
l0s AS (SELECT vec_id, count_if(v > 0) AS l0 FROM feats GROUP BY vec_id)"""


SQL_FIXTURE_LATENTS = sql_fixture_latents()
SQL_FIXTURE_FEATURES = sql_fixture_features()
