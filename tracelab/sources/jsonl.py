"""Resumable JSONL results (S9-S11): tolerant reading, keyed appends."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelab.sources.files import listed, opened

#: Bytes of a file that one task reads, and of a read from it.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20
LINES_AT_ONCE = 10_000


@dataclass
class ByteRange(InputPartition):
    """The lines of a file that start in [start, end)."""

    file: str
    start: int
    end: int


class TolerantJsonLines(DataSource):
    """JSON lines, each checked as it is read (``spark.read.format("tolerant_jsonl")``).

    A file is read in byte ranges (option ``rangebytes``) by as many tasks.
    Blank lines are skipped.  A line that is no JSON is given as not valid if it
    is the last of its file (a write cut short), else it is an error that names
    the file and the line: only then are the bytes after it looked at, or the
    lines before it counted, so no task needs to know of another's lines."""

    @classmethod
    def name(cls) -> str:
        return "tolerant_jsonl"

    def schema(self) -> str:
        return "file string, offset long, value string, valid boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        step = self.range_bytes
        return [ByteRange(f, s, min(size, s + step)) for f, size in listed(self.path) for s in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, _ = opened(self.path)
        with store.open_input_file(part.file) as f:
            size = f.size()
            rows: list[tuple] = []
            for offset, end, line in _lines(f, part, size):
                text = line.strip(b" \t\r\n\x0b\x0c")
                if not text:
                    continue
                try:
                    json.loads(text)
                    valid = True
                except ValueError:
                    if end < size:
                        raise ValueError(f"no JSON in line {_line_number(f, offset)} of {part.file}, which is not its last; look at the file before going on") from None
                    valid = False
                rows.append((part.file, offset, text.decode("utf-8", "replace"), valid))
                if len(rows) >= LINES_AT_ONCE:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "value", "valid"])


def _lines(f: pa.NativeFile, part: ByteRange, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the lines that start in the range; a line's end
    is past its line break."""
    at = part.start
    if at:  # a line that runs into the range belongs to the range before
        f.seek(at - 1)
        at -= 1
        while True:
            chunk = f.read(READ_BYTES)
            if not chunk:
                return
            cut = chunk.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(chunk)
    held, pos, ahead = b"", 0, at
    while at < part.end:
        cut = held.find(b"\n", pos)
        if cut < 0 and ahead < size:
            f.seek(ahead)  # (the reader may have looked elsewhere meanwhile)
            held, pos = held[pos:] + f.read(max(READ_BYTES, len(held) - pos)), 0
            ahead = at + len(held)
            continue
        stop = cut + 1 if cut >= 0 else len(held)
        if stop == pos:
            return
        yield at, at + stop - pos, held[pos:stop]
        at, pos = at + stop - pos, stop


def _line_number(f: pa.NativeFile, offset: int) -> int:
    f.seek(0)
    n, left = 1, offset
    while left:
        chunk = f.read(min(left, READ_BYTES))
        n, left = n + chunk.count(b"\n"), left - len(chunk)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The checked lines of the files at ``path`` (file, offset, value, valid)."""
    spark.dataSource.register(TolerantJsonLines)
    return spark.read.format("tolerant_jsonl").option("path", path).option("rangebytes", str(range_bytes)).load()


def read_jsonl_tolerant(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """JSON lines as VARIANT records.

    Blank lines are skipped; a malformed *last* line of a file is dropped
    and counted (a write cut short); a malformed earlier line raises, with its
    number.  Nothing is joined or shuffled to read the records.
    Returns (records[file, record VARIANT], stats[file, skipped_invalid_lines])."""
    lines = read_lines(spark, path, range_bytes)
    records = lines.filter("valid").select("file", F.try_parse_json("value").alias("record"))
    stats = lines.groupBy("file").agg(F.count_if(~F.col("valid")).alias("skipped_invalid_lines"))
    return records, stats


def recovered(spark: SparkSession, path: str, keys: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """The keys (name -> type) of the records at ``path``; None if nothing is there."""
    if not _exists(spark, path):
        return None
    lines = read_lines(spark, path, range_bytes).filter("valid").select(F.try_parse_json("value").alias("record"))
    return lines.select(*[F.try_variant_get("record", f"$.{k}", t).alias(k) for k, t in keys.items()])


def _write_counted(df: DataFrame, path: str, mode: str) -> int:
    """Write JSON lines and count them in the same pass: the rows' functions run once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


@dataclass
class AppendResult:
    written: int
    recovered: int
    skipped_invalid_lines: int
    total: int


def append_results(df: DataFrame, path: str, keys: list[str], mode: str = "new", range_bytes: int = RANGE_BYTES) -> AppendResult:
    """Write result records as JSON lines under ``path``.

    mode ``new``: the target must not exist; ``resume``: keep what is there
    and append only records whose key is unseen (anti join on ``keys``);
    ``overwrite``: restart.  Existing records missing a key field -> error.
    Returns counts written / recovered / skipped / total.
    """
    spark = df.sparkSession
    if mode not in ("new", "resume", "overwrite"):
        raise ValueError("mode must be new, resume or overwrite (resume and overwrite are exclusive)")
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"records have no key fields {absent}")
    exists = _exists(spark, path)
    if mode == "new" and exists:
        raise FileExistsError(f"{path} is there already; choose resume or overwrite")
    if mode == "resume" and exists:
        lines = read_lines(spark, path, range_bytes).select("valid", F.try_parse_json("value").alias("record"))
        missing = F.lit(False)
        for k in keys:
            missing = missing | F.variant_get(F.col("record"), f"$.{k}", "variant").isNull()
        fields = [F.try_variant_get("record", f"$.{k}", dict(df.dtypes)[k]).alias(k) for k in keys]
        # one pass over the old files gives the counts; the anti join is the second
        seen = lines.agg(F.count_if("valid").alias("n"), F.count_if(~F.col("valid")).alias("cut"), F.count_if(F.col("valid") & missing).alias("without")).first()
        if seen.without:
            raise ValueError(f"{seen.without} records in {path} have no value for one of {keys}; they were written by something else")
        todo = df.join(lines.filter("valid").select(*fields), keys, "left_anti")
        written = _write_counted(todo, path, "append")
        return AppendResult(written, seen.n, seen.cut, written + seen.n)
    written = _write_counted(df, path, "overwrite")
    return AppendResult(written, 0, 0, written)


def read_step_labels(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Strict load of label records with the fixed 15-field schema."""
    from tracelab.operators.runs import STEP_LABEL_SCHEMA

    return spark.read.schema(schema or STEP_LABEL_SCHEMA).option("mode", "FAILFAST").json(path)
