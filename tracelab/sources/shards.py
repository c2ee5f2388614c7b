"""Activation shards: write shuffled, size-capped parquet files per layer;
read them back with layer pruning; import safetensors shards; shard stats
(S5-S8)."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tracelab.operators.sae import list_matrix
from tracelab.sources.files import listed, opened

ACTIVATION_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("sample_id", T.LongType(), True),
        T.StructField("token_idx", T.LongType(), True),
        T.StructField("x", T.ArrayType(T.FloatType(), False), False),
    ]
)


def rows_per_shard(shard_mb: float, d_model: int, bytes_per_value: int = 4) -> int:
    """Rows that fit a shard of ``shard_mb`` MiB."""
    return max(1, int(shard_mb * 1024 * 1024) // (d_model * bytes_per_value))


def write_activation_shards(df: DataFrame, out: str, seed: int, shard_mb: float, d_model: int, key_col: str = "row_id", layer_col: str | None = "layer", mode: str = "errorifexists", bytes_per_value: int = 4) -> None:
    """Rows shuffled (seeded hash key: same order on any retry), then cut
    into parquet files of at most ``shard_mb`` of vectors each; one folder
    per layer (``layer=<n>``) when a layer column is given."""
    cap = rows_per_shard(shard_mb, d_model, bytes_per_value)
    key = F.xxhash64(F.lit(seed), F.col(key_col))
    shuffled = df.withColumn("_k", key).repartition("_k").sortWithinPartitions("_k").drop("_k")
    w = shuffled.write.mode(mode).option("maxRecordsPerFile", cap)
    if layer_col:
        w = w.partitionBy(layer_col)
    w.parquet(out)


def read_activations(spark: SparkSession, path: str, layer: int | None = None, layer_col: str = "layer") -> DataFrame:
    """Every shard under ``path``; ``layer`` filters the partition column
    (folders of other layers are not read).  An empty folder is an error."""
    from tracelab.sources.datasets import list_files

    if list_files(spark, path).filter(F.col("name").endswith(".parquet")).isEmpty():
        raise ValueError(f"No activation shards found in {path}")
    df = spark.read.parquet(path)
    if layer is not None:
        if layer_col not in df.columns:
            raise ValueError(f"{path} has no {layer_col} partitions")
        df = df.filter(F.col(layer_col) == layer)
    return df


def shard_stats(spark: SparkSession, path: str, batch_size: int) -> DataFrame:
    """Per folder bytes (GiB), files, rows and batches = ceil(rows / batch).
    Rows are counted from parquet footers' row counts via a metadata scan."""
    df = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    per_file = df.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("bytes"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return per_file.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("rows").alias("rows"),
        (F.sum("bytes") / float(1 << 30)).alias("size_gib"),
        F.ceil(F.sum("rows") / F.lit(batch_size)).alias("batches"),
    )


# Fixed values of the format: how a tensor's element types are stored.
DTYPES = {"F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8"}
#: Bytes of a tensor that one task reads, rows of a batch, and rows of a written file.
READ_BYTES, BATCH_BYTES = 8 << 20, 4 << 20


@dataclass
class RowRange(InputPartition):
    """Rows [lo, hi) of a file's tensor, and where they (and their ids) lie."""

    file: str
    lo: int
    hi: int
    width: int
    dtype: str
    at: int
    ids_at: int


class TensorShards(DataSource):
    """``.safetensors`` shards as rows (``format("tensor_shards")``): file, row,
    row_id, x.  The header of a file tells where its tensor lies, so one file is
    read by many tasks, each a range of rows; nothing is read whole.  Options:
    path, ``tensor`` (default activations), ``ids`` (the tensor of row ids, null
    if there is none).  Writing (row_id, x) makes one file a task and
    ``shardrows`` rows; files of failed tasks are removed."""

    @classmethod
    def name(cls) -> str:
        return "tensor_shards"

    def schema(self) -> str:
        return "file string, row long, row_id long, x array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TensorReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TensorWriter(self.options, [f.name for f in schema])


def _header(f: pa.NativeFile) -> tuple[dict, int]:
    """The header of a shard, and where the bytes of its tensors begin."""
    n = int.from_bytes(f.read(8), "little")
    return json.loads(f.read(n)), 8 + n


class _TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tensor, self.ids = options["path"], options.get("tensor", "activations"), options.get("ids", "row_ids")
        self.range_bytes = int(options.get("rangebytes", READ_BYTES))

    def partitions(self) -> list[RowRange]:
        out = []
        store, _ = opened(self.path)
        for file, _size in listed(self.path, ".safetensors"):
            with store.open_input_file(file) as f:
                header, base = _header(f)
            meta = header[self.tensor]
            dtype, shape = meta["dtype"].upper(), meta["shape"]
            if dtype not in DTYPES or dtype == "I64":
                raise ValueError(f"tensor {self.tensor} of {file} has elements of type {dtype}, which is not read")
            width = shape[-1] if shape else 1
            rows = int(np.prod(shape)) // max(1, width)
            size = np.dtype(DTYPES[dtype]).itemsize * width
            at = base + meta["data_offsets"][0]
            ids_at = base + header[self.ids]["data_offsets"][0] if self.ids in header else -1
            step = max(1, self.range_bytes // max(1, size))
            out += [RowRange(file, lo, min(rows, lo + step), width, dtype, at, ids_at) for lo in range(0, rows, step)]
        return out or [RowRange("", 0, 0, 1, "F32", 0, -1)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        kind = np.dtype(DTYPES[part.dtype])
        size = kind.itemsize * part.width
        step = max(1, BATCH_BYTES // max(1, size))
        with opened(self.path)[0].open_input_file(part.file) as f:
            for lo in range(part.lo, part.hi, step):
                n = min(step, part.hi - lo)
                f.seek(part.at + lo * size)
                x = np.frombuffer(f.read(n * size), kind)
                x = (x.astype(np.uint32) << 16).view(np.float32) if part.dtype == "BF16" else x.astype(np.float32)
                ids = pa.nulls(n, pa.int64())
                if part.ids_at >= 0:
                    f.seek(part.ids_at + 8 * lo)
                    ids = pa.array(np.frombuffer(f.read(8 * n), "<i8"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(np.arange(lo, lo + n)), ids, lists], names=["file", "row", "row_id", "x"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _TensorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.tensor, self.ids = options["path"], options.get("tensor", "activations"), options.get("ids", "row_ids")
        self.rows, self.dtype = int(options.get("shardrows", 0)), options.get("dtype", "F32").upper()
        if columns != ["row_id", "x"]:
            raise ValueError(f"shards are written from row_id and x, not {columns}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        files, ids, xs, held = [], [], [], 0

        def put(n: int) -> None:
            nonlocal ids, xs, held
            all_ids, all_x = np.concatenate(ids), np.concatenate(xs)
            name = posixpath.join(root, f"shard-{uuid.uuid4().hex}.safetensors")
            with store.open_output_stream(name) as f:
                f.write(shard_bytes({self.tensor: (all_x[:n], self.dtype), self.ids: (all_ids[:n], "I64")}))
            files.append(name)
            ids, xs, held = [all_ids[n:]], [all_x[n:]], held - n

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            xs.append(list_matrix(b.column(1)).astype(np.float32))
            held += b.num_rows
            cap = self.rows or max(1, (100 << 20) // (4 * xs[0].shape[1]))
            while held >= cap:
                put(cap)
        if held:
            put(held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                store.delete_file(f)


def shard_bytes(tensors: dict[str, tuple[np.ndarray, str]]) -> bytes:
    """A shard: 8 bytes with the header's length, the header, the tensors."""
    header, parts, at = {}, [], 0
    for name, (m, dtype) in tensors.items():
        if dtype == "BF16":  # the upper half of each number
            raw = (np.ascontiguousarray(m, np.float32).view(np.uint32) >> 16).astype("<u2").tobytes()
        else:
            raw = np.ascontiguousarray(m).astype(DTYPES[dtype]).tobytes()
        header[name] = {"dtype": dtype, "shape": list(m.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(header).encode()
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def import_tensor_shards(spark: SparkSession, path: str, tensor: str = "activations", range_bytes: int = READ_BYTES) -> DataFrame:
    """Existing ``.safetensors`` shards as activation rows (file, row,
    row_id, x); (file, row) is stable across retries."""
    spark.dataSource.register(TensorShards)
    return spark.read.format("tensor_shards").option("path", path).option("tensor", tensor).option("rangebytes", str(range_bytes)).load()


def export_tensor_shards(df: DataFrame, path: str, row_id_col: str = "row_id", x_col: str = "x", tensor: str = "activations", shard_rows: int = 0, dtype: str = "F32") -> None:
    """S7 the other way: rows to ``.safetensors`` shards (ids beside the vectors)."""
    df.sparkSession.dataSource.register(TensorShards)
    rows = df.select(F.col(row_id_col).cast("long").alias("row_id"), F.col(x_col).cast("array<float>").alias("x"))
    rows.write.format("tensor_shards").option("path", path).option("tensor", tensor).option("shardrows", str(shard_rows)).option("dtype", dtype).mode("append").save()
