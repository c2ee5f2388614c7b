"""Session helpers: builder for local runs, checkpoint folder, size guards."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Upper bound for anything this library ships to executors as a broadcast
# (model parameters, small lookup tables).  Bigger objects take the
# partitioned path of the operator instead.
DEFAULT_BROADCAST_BUDGET = 256 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tracelab") -> SparkSession:
    """Session for tests and benchmarks (single JVM)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACELAB_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


# A table of fewer bytes than this for every second core has fewer splits than cores.
SPLIT_BYTES = 128 * 1024 * 1024
# The least that a task should be given when rows are dealt anew.
SPREAD_BYTES = 256 * 1024


def spread(df: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a small table dealt round robin over the session's cores.

    A scan makes no more tasks than the files have row groups, so a small file
    is worked by one task, text functions and Python included.  A table that
    has splits for half the cores is left as it is: nothing is shuffled there.
    """
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(cores, -(-size // SPREAD_BYTES))
    return df if tasks < 2 or 2 * size >= cores * split_bytes else df.repartition(tasks)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    Only where all tasks run in the driver's process (``local[...]``: tests,
    benchmarks) is a scratch folder set if there is none; on a cluster that
    would be a folder of one machine, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tracelab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tracelab`` importable in the Python workers of this session.

    Task code (Arrow kernels, pandas functions) refers to this package's
    functions, so executors need it: the package is zipped on the driver and
    distributed with ``addPyFile`` (once per application).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="tracelab-pkg-"), "tracelab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
