"""Dataset ingestion: local/remote file trees of parquet / json / jsonl / csv
(S1-S4).  One Spark job lists the files (any store Spark reads); format and
split of a file are column expressions of its path, and each split is read by
Spark's own readers."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes, ignored metadata files, known split names.
SUPPORTED_SUFFIXES = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv"}
IGNORED_JSON_FILES = {"dataset_infos.json", "dataset_info.json", "state.json"}
SPLIT_NAMES = ("train", "test", "validation", "valid", "val", "dev")

DEFAULT_SPLIT = "train"
#: Names that mean another split.
SAME_SPLIT = {"valid": "validation", "val": "validation"}
#: The last folder or file of a path that names a split: the name alone, with
#: something after ``-`` or ``_``, or with one suffix; ``split=`` may precede it.
#: (Greedy up to the last slash, so the deepest part that fits is taken.)
SPLIT_PART = r"(?i)^(?:.*/)?(?:split=)?(" + "|".join(SPLIT_NAMES) + r")(?:[-_][^/]*|\.[^./]*)?(?:/.*)?$"


def _plain(path: Column) -> Column:
    """A file path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def split_of(path: Column | str, root: str) -> Column:
    """The split that a file's path below ``root`` names, else train."""
    c = _plain(F.col(path) if isinstance(path, str) else path)
    base = root if "://" in root and not root.startswith("file:") else "/" + root.removeprefix("file:").lstrip("/")
    base = base.rstrip("/")
    below = F.when(c.startswith(base + "/"), F.substring(c, len(base) + 2, 1 << 30)).otherwise(F.substring_index(c, "/", -1))
    name = F.lower(F.regexp_extract(below, SPLIT_PART, 1))
    same = F.create_map(*[F.lit(x) for pair in SAME_SPLIT.items() for x in pair])
    return F.coalesce(same[name], F.nullif(name, F.lit("")), F.lit(DEFAULT_SPLIT))


def with_split(df: DataFrame, root: str, name: str = "split") -> DataFrame:
    """S2 on rows: the split of the file each row was read from (``df`` comes
    straight from a reader over files below ``root``)."""
    return df.withColumn(name, split_of(F.col("_metadata.file_path"), root))


def qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """``root`` with its scheme, and whether it is one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    return fs.makeQualified(path).toString(), fs.getFileStatus(path).isFile()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The files at or below ``root`` (path, name, bytes), listed by Spark;
    their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))


def discover(spark: SparkSession, root: str) -> tuple[str, dict[str, list[str]]]:
    """S1 listing: (format, {split: [files]}); more than one format or none
    -> error; metadata json files are skipped."""
    base, single = qualified(spark, root)
    fmt = F.coalesce(*[F.when(F.col("name").endswith(suffix), F.lit(kind)) for suffix, kind in SUPPORTED_SUFFIXES.items()])
    hidden = F.col("name").startswith(".") | F.col("name").startswith("_") | F.col("name").isin(*IGNORED_JSON_FILES)
    split = F.lit(DEFAULT_SPLIT) if single else split_of("path", base)  # a single data file is the train split
    files = list_files(spark, root).filter(~hidden).select("path", fmt.alias("fmt"), split.alias("split")).filter("fmt IS NOT NULL")
    rows = files.orderBy("path").collect()  # paths only: the readers take them as a list
    formats = sorted({r.fmt for r in rows})
    if len(formats) != 1:
        raise ValueError(f"{root} holds {'files of several formats: ' + ', '.join(formats) if formats else 'no parquet, json, jsonl or csv files'}")
    splits: dict[str, list[str]] = {}
    for r in rows:
        splits.setdefault(r.split, []).append(r.path)
    return formats[0], splits


def _reader(spark: SparkSession, fmt: str, multi_line: bool):
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true").option("inferSchema", "true").option("multiLine", str(multi_line).lower())
    return r


def _choose(splits: list[str], wanted: str) -> str:
    if wanted in splits:
        return wanted
    if len(splits) == 1:
        return splits[0]
    raise ValueError(f"no split {wanted!r}; there are {', '.join(sorted(map(str, splits)))}")


def read_dataset(spark: SparkSession, root: str, split: str | None = "train", with_split: bool = True, multi_line: bool = True) -> DataFrame:
    """S1 + S3: read one split of a dataset folder (or every split when
    ``split`` is None, with a ``split`` column).  Unknown split: the only
    split when there is just one, else an error listing the splits.
    ``multi_line=False`` reads CSV files whose quoted fields hold no line
    breaks by many tasks each."""
    fmt, splits = discover(spark, root)
    chosen = sorted(splits) if split is None else [_choose(list(splits), split)]
    out = None
    for s in chosen:
        d = _reader(spark, fmt, multi_line).load(splits[s])
        if with_split:
            d = d.withColumn("split", F.lit(s))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def select_split(df: DataFrame, name: str, split_col: str = "split") -> DataFrame:
    """S3 on a DataFrame with a split column (distinct splits are few)."""
    return df.filter(F.col(split_col) == _choose([r[0] for r in df.select(split_col).distinct().collect()], name))


def write_splits(df: DataFrame, out: str, overwrite: bool = False, split_col: str = "split") -> None:
    """One parquet set per split under ``out/data`` (``split=<name>``
    folders); an existing target without ``overwrite`` is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(split_col).parquet(posixpath.join(out, "data"))
