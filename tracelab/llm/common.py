"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.session import ensure_checkpoint_dir

#: A word in every contract of this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = " \t\n\x0b\x0c\r"

#: Tables up to this many (narrow) rows are joined by broadcast; larger ones by shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tracelab-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, runs
    the work once, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stashed narrow table for broadcast if it has few rows; a larger
    one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an array expression to a lambda variable so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, a null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def words_of(text: Column) -> Column:
    """The words of a text as an array (null: empty array)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))
