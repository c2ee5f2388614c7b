"""Structured Streaming operators.

Streams read files as they appear (activation shards, example files).
Stateless per-row work (SAE features) runs inside the stream; work that
needs a window over a text or a join against already written output runs
per micro-batch in ``foreachBatch`` and writes one folder per batch id, so a
retried micro-batch replaces its own output (exactly-once on restart).
State kept across micro-batches is one row of fixed size per latent (a bitmap
of the batches seen lately, so that files may come in any order) or one short
key per label record written.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelab.session import ensure_checkpoint_dir


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    file_glob: str | None = None,
    max_files_per_trigger: int | None = 1,
    delete_after_read: bool = False,
) -> DataFrame:
    """Consume files of ``path`` as they appear; ``delete_after_read``
    removes consumed files (off by default)."""
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if delete_after_read:
        r = r.option("cleanSource", "delete")
    return r.load(path)


def stream_activations(spark: SparkSession, path: str, schema: T.StructType, delete_after_read: bool = False, **kw) -> DataFrame:
    """T1 for activation shards (parquet)."""
    return stream_files(spark, path, schema, "parquet", delete_after_read=delete_after_read, **kw)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return posixpath.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")


#: Batches that a latent's bitmap covers, up to the last one it was seen in.
HORIZON = 8192


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (latent_id, batch) pairs of a task's rows, so that a latent
    that is always on sends no more rows on than it has batches."""
    held = None
    for b in batches:
        part = pa.Table.from_batches([b]).group_by(["latent_id", "batch"]).aggregate([])
        held = part if held is None else pa.concat_tables([held, part]).group_by(["latent_id", "batch"]).aggregate([])
    if held is not None:
        yield from held.select(["latent_id", "batch"]).combine_chunks().to_batches()


def _mark(bits: np.ndarray, low: int, count: int, late: int, batches: np.ndarray) -> tuple[int, int, int]:
    """Count the batches not seen before.  ``bits`` holds batch b (from ``low``
    to ``low`` + its length) at place b modulo its length; a batch beyond moves
    ``low`` on and clears the places it passes, one before ``low`` is late."""
    size = len(bits)
    for b in np.unique(batches).tolist():
        if b < low:
            late += 1
            continue
        if b >= low + size:
            new = b - size + 1
            passed = np.arange(low, min(new, low + size))
            bits[passed % size] = 0
            low = new
        if not bits[b % size]:
            bits[b % size] = 1
            count += 1
    return low, count, late


def stream_latent_activity(features: DataFrame, batch_col: str = "batch", horizon: int = HORIZON) -> DataFrame:
    """Running A5 over a stream of top-k features: per latent, batches in
    which it was selected and the last such batch, in whatever order rows and
    files come.

    A latent's state is one bitmap of ``horizon`` batches (a bit each) and three
    numbers, however long the stream runs.  A batch counts once; one that comes
    more than ``horizon`` batches after a later one of its latent can no longer
    be told from a repeat, so it is not counted but reported in ``late``.
    ``seq`` grows with every update of a latent."""
    pairs = features.select(F.col("latent_id").cast("long").alias("latent_id"), F.col(batch_col).cast("long").alias("batch")).where("batch IS NOT NULL")
    pairs = pairs.mapInArrow(_distinct_pairs, "latent_id long, batch long")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            packed, low, count, late, last, seq = state.get
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[:horizon].copy()
        else:
            bits, low, count, late, last, seq = np.zeros(horizon, np.uint8), 0, 0, 0, -1, 0
        for part in parts:
            batches = part["batch"].to_numpy()
            low, count, late = _mark(bits, low, count, late, batches)
            last = max(last, int(batches.max()))
        state.update((np.packbits(bits, bitorder="little").tobytes(), low, count, late, last, seq + 1))
        yield pd.DataFrame({"latent_id": [key[0]], "activation_count": [count], "last_batch": [last], "late": [late], "seq": [seq + 1]})

    return pairs.groupBy("latent_id").applyInPandasWithState(
        update,
        "latent_id long, activation_count long, last_batch long, late long, seq long",
        "bits binary, low long, count long, late long, last long, seq long",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def run_to_table(stream_df: DataFrame, name: str, output_mode: str = "update") -> DataFrame:
    """Drive a stream over everything available now into Parquet in the shared
    folder (one folder a micro-batch, overwritten on a retry) and read it back."""
    spark = stream_df.sparkSession
    at = checkpoint_location(spark, name)
    out = posixpath.join(at, "out")

    def sink(batch_df: DataFrame, batch_id: int):
        batch_df.write.mode("overwrite").parquet(posixpath.join(out, f"batch_id={batch_id}"))

    q = (
        stream_df.writeStream.outputMode(output_mode)
        .foreachBatch(sink)
        .option("checkpointLocation", posixpath.join(at, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    spark.createDataFrame([], stream_df.schema).write.mode("overwrite").parquet(posixpath.join(out, "batch_id=-1"))
    return spark.read.schema(stream_df.schema).parquet(out).select(*stream_df.columns)


def latest_activity(updates: DataFrame, d_sae: int) -> DataFrame:
    """Final state of T2 as the A5 table (grid-completed; steps since the last
    selection counted from the last batch of the stream)."""
    from pyspark.sql import Window

    spark = updates.sparkSession
    last = updates.groupBy("latent_id").agg(F.max_by(F.struct("activation_count", "last_batch"), "seq").alias("s"))
    grid = spark.range(d_sae).withColumnRenamed("id", "latent_id")
    j = grid.join(last, "latent_id", "left")
    nb = F.max("s.last_batch").over(Window.partitionBy()) + 1
    return j.select(
        "latent_id",
        F.coalesce(F.col("s.activation_count"), F.lit(0)).cast("long").alias("activation_count"),
        F.coalesce(nb - 1 - F.col("s.last_batch"), nb).cast("long").alias("steps_since"),
    )


def foreach_batch_to_folder(stream_df: DataFrame, out: str, transform: Callable[[DataFrame, int], DataFrame], name: str) -> str:
    """Run ``transform`` on every micro-batch and write its result to
    ``out/batch_id=<id>`` (overwritten on a retry of the same batch).  The
    stream's checkpoint lives in ``out/_checkpoint`` (skipped by parquet
    readers), so running again over the same output resumes where the last
    run stopped."""

    def sink(batch_df: DataFrame, batch_id: int):
        res = transform(batch_df, batch_id)
        res.write.mode("overwrite").parquet(posixpath.join(out, f"batch_id={batch_id}"))

    q = (
        stream_df.writeStream.foreachBatch(sink)
        .option("checkpointLocation", posixpath.join(out, "_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out


def stream_segment(examples: DataFrame, out: str, text_col: str, id_col: str, delim: str = "\n\n") -> str:
    """X1 on a stream of examples, per micro-batch."""
    from tracelab.operators.segment import segment_steps

    return foreach_batch_to_folder(examples, out, lambda df, _bid: segment_steps(df, text_col, id_col, delim, with_text=False), "segment")


def _entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "*"))
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return [f.getPath().getName() for f in found or ()]


def stream_label_steps(steps: DataFrame, out: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """T4: label steps of a stream and append them exactly once: the stream's
    state holds a 128-bit digest of every key seen (streaming deduplication), so
    no micro-batch reads what earlier ones wrote, and a retried one replaces its
    own folder.  ``prepare`` turns inputs into steps row by row (e.g. X1).

    Output that lies there before the stream first starts counts as written: the
    digests of its keys are put into ``out/_earlier`` once and anti-joined."""
    from tracelab.functions.cues import cue_label, cue_rationale

    spark = steps.sparkSession
    if prepare is not None:
        steps = prepare(steps)
    digest = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    names = _entries(spark, out)
    earlier = posixpath.join(out, "_earlier")
    if "_checkpoint" not in names and any(n.startswith("batch_id=") for n in names):
        spark.read.parquet(out).select(digest.alias("_key")).distinct().write.mode("overwrite").parquet(earlier)
        names.append("_earlier")
    keyed = steps.withColumn("_key", digest)
    if "_earlier" in names:
        keyed = keyed.join(spark.read.parquet(earlier), "_key", "left_anti")
    fresh = keyed.dropDuplicates(["_key"]).drop("_key")
    labelled = fresh.select("*", cue_label("step_text").alias("label"), cue_rationale("step_text").alias("label_rationale"))
    # batches of an earlier stream keep their folders
    taken = max((int(n.split("=")[1]) + 1 for n in names if n.startswith("batch_id=")), default=0) if "_checkpoint" not in names else 0
    first = _first_batch(spark, out, taken)

    def sink(batch_df: DataFrame, batch_id: int):
        batch_df.write.mode("overwrite").parquet(posixpath.join(out, f"batch_id={first + batch_id}"))

    q = labelled.writeStream.foreachBatch(sink).option("checkpointLocation", posixpath.join(out, "_checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def _first_batch(spark: SparkSession, out: str, wanted: int) -> int:
    """The number of this output's first folder, fixed when its stream first starts."""
    at = posixpath.join(out, "_first")
    if "_first" not in _entries(spark, out):
        spark.range(wanted, wanted + 1).coalesce(1).write.parquet(at)
    return spark.read.parquet(at).first()[0]


def stream_recon_metrics(rows: DataFrame, out: str, d_model: int) -> str:
    """T5: reconstruction metrics per micro-batch (from SAE forward rows)."""
    from tracelab.operators.stats import recon_metrics

    return foreach_batch_to_folder(
        rows, out, lambda df, bid: recon_metrics(df, d_model).withColumn("micro_batch", F.lit(bid).cast("long")), "recon"
    )


def running_best(metrics: DataFrame, value_col: str = "l2_ratio") -> DataFrame:
    """T5 + W4: best value so far over the micro-batches."""
    from tracelab.operators.sampling import best_so_far

    return best_so_far(metrics, "micro_batch", value_col)
