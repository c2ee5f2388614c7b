"""Sampling, splits, layer grids, dataset round trips, shards (golden cases)."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.operators.sampling import assign_batches, layer_grid, mix_sources, sample_by_weight, sample_n
from tracelab.sources.datasets import read_dataset, select_split, split_of, with_split, write_splits
from tracelab.sources.shards import export_tensor_shards, import_tensor_shards, read_activations, shard_bytes, shard_stats, write_activation_shards

ROWS = [(f"p{i}", i % 5, "algebra" if i % 2 else "geometry", f"s{i}") for i in range(10)]
SCHEMA = "problem string, level long, type string, solution string"


def test_sample_is_deterministic(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("split", F.lit("train"))
    a = sorted(r.problem for r in sample_n(df, 4, 7, "problem").collect())
    b = sorted(r.problem for r in sample_n(df, 4, 7, "problem").collect())
    assert a == b and len(a) == 4
    assert sample_n(df, 4, 7, "problem").columns == df.columns
    assert sample_n(df, 50, 7, "problem").count() == 10
    with pytest.raises(ValueError):
        sample_n(df, 0, 7, "problem")


def test_splits_survive_write_and_read(spark, tmp_path):
    src = tmp_path / "src"
    tr = spark.createDataFrame(ROWS[:6], SCHEMA)
    va = spark.createDataFrame(ROWS[6:], SCHEMA)
    tr.coalesce(1).write.parquet(str(src / "train.parquet"))
    va.coalesce(1).write.parquet(str(src / "validation.parquet"))
    (src / "dataset_infos.json").write_text("{}")
    df = read_dataset(spark, str(src), split=None)
    assert {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 6, "validation": 4}
    sampled = sample_n(df, 3, 42, "problem")
    write_splits(sampled, str(tmp_path / "out"))
    back = read_dataset(spark, str(tmp_path / "out"), split=None)
    assert {r.split: r.n for r in back.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 3, "validation": 3}
    assert set(back.columns) >= {"problem", "level", "type", "solution"}
    with pytest.raises(Exception):
        write_splits(sampled, str(tmp_path / "out"))
    assert select_split(back, "validation").count() == 3
    with pytest.raises(ValueError):
        select_split(back, "test")


def test_split_from_path(spark):
    cases = {
        "/d/data/train-00000-of-00001.parquet": "train",
        "/d/valid/x.json": "validation",
        "/d/val.json": "validation",
        "/d/dev_1.csv": "dev",
        "/d/other.parquet": "train",
        "/d/data/split=test/part-0.parquet": "test",
        "/d/test/train.parquet": "train",
        "/d/TEST/part.parquet": "test",
        "/d/testing/part.parquet": "train",
        "/d/dev.x.parquet": "train",
        "/d/test/dev.x.parquet": "test",
        "file:///d/test/a.parquet": "test",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    for root in ("/d", "/d/", "file:/d", "file:///d"):
        assert {r.path: r.s for r in df.select("path", split_of("path", root).alias("s")).collect()} == cases
    assert df.limit(1).select(split_of(F.lit("/test/x/part.json"), "/test/x").alias("s")).first().s == "train"  # the root itself names nothing


def test_split_column_of_rows(spark, tmp_path):
    for name, n in (("train", 3), ("val_1", 2), ("misc", 1)):
        spark.range(n).coalesce(1).write.json(str(tmp_path / name))
    df = spark.read.option("recursiveFileLookup", "true").json(str(tmp_path))
    assert {r.split: r["count"] for r in with_split(df, str(tmp_path)).groupBy("split").count().collect()} == {"train": 4, "validation": 2}


def test_mixed_formats_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n')
    (tmp_path / "b.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        read_dataset(spark, str(tmp_path))


def test_layer_specs():
    assert layer_grid(layers="12, 4,12, 20") == [4, 12, 20]
    assert layer_grid(layer_range="8:24:4") == [8, 12, 16, 20, 24]
    assert layer_grid(layer_range="0:24", layer_step=4, final_layer=27) == [0, 4, 8, 12, 16, 20, 24, 27]
    assert layer_grid(layer_range="0:24", layer_step=6, final_layer=27) == [0, 6, 12, 18, 24, 27]
    with pytest.raises(ValueError):
        layer_grid(layer_range="0:24:4", layer_step=4)
    with pytest.raises(ValueError):
        layer_grid(layers="1,2", layer_range="0:4")


def test_batches_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k")
    b = {r.k: r.batch for r in assign_batches(df, 64, "k").collect()}
    assert all(b[k] == k // 64 for k in range(1000))


def test_mix_without_cap_keeps_all_rows(spark):
    r = spark.range(100).withColumnRenamed("id", "k")
    g = spark.range(1000, 1300).withColumnRenamed("id", "k")
    m = mix_sources(r, g, 0.8, "k").collect()
    assert len(m) == 400
    first = [x.source for x in m[:100]]
    assert first.count("reasoning") > 50  # ratio shapes the prefix
    only_r = mix_sources(r, g, 1.0, "k")
    assert only_r.count() == 100


def test_weighted_draws_follow_weights(spark):
    w = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "k long, w double")
    d = sample_by_weight(w, "w", "k", 4000, 5).collect()
    assert len(d) == 4000 and {r.draw for r in d} == set(range(4000))
    c = {k: sum(1 for r in d if r.k == k) for k in (0, 1, 2)}
    assert c[0] == 0 and 0.2 < c[1] / 4000 < 0.3


def test_activation_shards_round_trip(spark, tmp_path):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = emb.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 4).alias("layer"), F.col("embedding").alias("x"))
    out = str(tmp_path / "shards")
    write_activation_shards(df, out, seed=1, shard_mb=0.01, d_model=64)
    assert read_activations(spark, out, layer=1).count() == emb.filter("vec_id % 4 = 1").count()
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert len(files) > 4
    st = shard_stats(spark, out, 32).collect()
    assert sum(r.rows for r in st) == emb.count()
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_text("no shards")
    with pytest.raises(ValueError):
        read_activations(spark, str(empty))


def test_safetensors_import(spark, tmp_path):
    m = np.arange(120, dtype=np.float32).reshape(30, 4) / 8
    (tmp_path / "a.safetensors").write_bytes(shard_bytes({"activations": (m, "F32"), "row_ids": (np.arange(30) + 100, "I64")}))
    (tmp_path / "b.safetensors").write_bytes(shard_bytes({"other": (m[:1], "F32"), "activations": (m * 2, "BF16")}))
    (tmp_path / "c.safetensors").write_bytes(shard_bytes({"activations": (m.reshape(15, 2, 4), "F16")}))
    (tmp_path / "skip.bin").write_bytes(b"x")
    df = import_tensor_shards(spark, str(tmp_path), range_bytes=64)  # ranges of 4 and 8 rows
    assert df.rdd.getNumPartitions() >= 3 * 30 // 8
    got = {(os.path.basename(r.file), r.row): (r.row_id, r.x) for r in df.collect()}
    assert len(got) == 90
    for i in range(30):
        assert got["a.safetensors", i][0] == 100 + i and np.allclose(got["a.safetensors", i][1], m[i])
        assert got["b.safetensors", i][0] is None and np.allclose(got["b.safetensors", i][1], m[i] * 2)
        assert np.allclose(got["c.safetensors", i][1], m[i])


def test_safetensors_export(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 3).alias("row_id"), F.array(*[(F.col("id") + i).cast("float") for i in range(5)]).alias("x"))
    export_tensor_shards(rows.repartition(3), str(tmp_path / "out"), shard_rows=16)
    files = list((tmp_path / "out").glob("*.safetensors"))
    assert 7 <= len(files) <= 10
    back = import_tensor_shards(spark, str(tmp_path / "out"))
    assert sorted((r.row_id, *r.x) for r in back.collect()) == [(3 * i, *(float(i + j) for j in range(5))) for i in range(100)]


def test_draws_do_not_depend_on_partitioning(spark):
    from tracelab.operators.segment import question_fallback

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = docs.repartition(1), docs.repartition(7, "lang")
    s1 = sorted(r.doc_id for r in sample_n(one, 5, 3, "doc_id", by="lang").collect())
    s2 = sorted(r.doc_id for r in sample_n(many, 5, 3, "doc_id", by="lang").collect())
    assert s1 == s2
    f1 = sorted(r.doc_id for r in question_fallback(one, "doc_id", 0.3, 1).collect())
    f2 = sorted(r.doc_id for r in question_fallback(many, "doc_id", 0.3, 1).collect())
    assert f1 == f2 and 0 < len(f1) < docs.count()
    m1 = [(r.source, r.k) for r in mix_sources(one.select(F.col("doc_id").alias("k")), many.select((F.col("doc_id") + 10**6).alias("k")), 0.5, "k").collect()]
    m2 = [(r.source, r.k) for r in mix_sources(many.select(F.col("doc_id").alias("k")), one.select((F.col("doc_id") + 10**6).alias("k")), 0.5, "k").collect()]
    assert m1 == m2
    w = docs.select("doc_id", F.col("n_chars").cast("double").alias("w"))
    d1 = sorted((r.draw, r.doc_id) for r in sample_by_weight(w.repartition(1), "w", "doc_id", 50, 2).collect())
    d2 = sorted((r.draw, r.doc_id) for r in sample_by_weight(w.repartition(5), "w", "doc_id", 50, 2).collect())
    assert d1 == d2
    b1 = {r.doc_id: r.batch for r in assign_batches(one.select("doc_id"), 16, "doc_id").collect()}
    b2 = {r.doc_id: r.batch for r in assign_batches(many.select("doc_id"), 16, "doc_id").collect()}
    assert b1 == b2


def test_single_file_is_train(spark, tmp_path):
    p = tmp_path / "test.jsonl"
    p.write_text('{"problem": "a"}\n{"problem": "b"}\n')
    df = read_dataset(spark, str(p), split=None)
    assert {r.split for r in df.collect()} == {"train"} and df.count() == 2


def test_csv_folders_and_split_names(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "val").mkdir()
    (tmp_path / "train" / "part.csv").write_text('question,answer\n"multi\nline",1\nq2,2\n')
    (tmp_path / "val" / "part.csv").write_text("question,answer\nq3,3\n")
    df = read_dataset(spark, str(tmp_path), split=None)
    got = {(r.split, r.question, r.answer) for r in df.collect()}
    assert got == {("train", "multi\nline", 1), ("train", "q2", 2), ("validation", "q3", 3)}
    assert read_dataset(spark, str(tmp_path), split="validation").count() == 1


def test_global_index_on_many_rows(spark):
    from tracelab.operators.sampling import assign_batches, partition_index

    rows = spark.range(600_000).select(((F.col("id") * 7919) % 600_011).alias("key"), F.md5(F.col("id").cast("string")).alias("payload"))
    idx = partition_index(rows, "key", "i")
    r = idx.agg(F.countDistinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n")).first()
    assert (r.d, r.lo, r.hi, r.n) == (600_000, 0, 599_999, 600_000)
    sizes = sorted(x["count"] for x in assign_batches(rows, 4096, ["key"]).groupBy("batch").count().collect())
    assert sizes == [600_000 % 4096, *[4096] * (600_000 // 4096)]


def test_repeated_keys_spread_over_buckets(spark):
    from tracelab.operators.sampling import partition_index, range_buckets, row_hash

    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("key"), "id")
    tied = range_buckets(rows.withColumn("_tie", row_hash(rows)), ["key", "_tie"], "b", buckets=16)
    sizes = sorted(r["count"] for r in tied.groupBy("b").count().collect())
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
    one = {r.id: r.i for r in partition_index(rows, "key", "i").collect()}
    other = {r.id: r.i for r in partition_index(rows.repartition(5), "key", "i").collect()}
    assert one == other and sorted(one.values()) == list(range(200_000))


def test_interleave_counts_every_source(spark):
    from tracelab.operators.sampling import interleave

    src = {n: spark.range(k).select("id") for n, k in (("b", 5), ("a", 3), ("c", 9))}
    got = sorted((r.source, r.rn, r.id) for r in interleave(src, "id").collect())
    assert got == [(n, i, i) for n in "abc" for i in range(3)]
    assert interleave({**src, "d": spark.range(0).select("id")}, "id").count() == 0


def test_weighted_draws_in_salted_buckets(spark, monkeypatch):
    from tracelab.operators import sampling

    monkeypatch.setattr(sampling, "GROUP_DRAWS", 50)
    rows = spark.createDataFrame([(i, 1000.0 if i == 3 else float(i % 4)) for i in range(200)] + [(500, float("inf")), (501, float("nan")), (502, None)], "k long, w double")
    got = sampling.sample_by_weight(rows, "w", "k", 3000, 1, buckets=8).collect()
    assert sorted(r.draw for r in got) == list(range(3000))
    assert abs(sum(r.k == 3 for r in got) / 3000 - 1000 / (1000 + 297)) < 0.03
    assert not any(r.k % 4 == 0 or r.k >= 500 for r in got)
    assert sampling.sample_by_weight(rows.limit(0), "w", "k", 5, 1).count() == 0
