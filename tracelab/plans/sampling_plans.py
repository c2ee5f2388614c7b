"""Registered plans for sampling, mixing, batching and dataset I/O."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tracelab.functions.text import SOLUTION_HEADER
from tracelab.functions.vectors import bf16_round
from tracelab.operators.fit import residual_directions
from tracelab.operators.sae import fixture_params, init_params_frame, sae_features, sae_forward_rows
from tracelab.operators.sampling import (
    assign_batches,
    best_so_far,
    global_shuffle,
    interleave,
    layer_grid,
    limit_rows,
    mix_sources,
    repeat_epochs,
    sample_by_weight,
    sample_n,
    select_layers,
    sources_summary,
    train_curve,
    union_sources,
)
from tracelab.operators.segment import pad_batch, question_fallback
from tracelab.plans.common import r6, register, sql_fixture_features, sql_fixture_residuals, table
from tracelab.plans.fixtures import conversation_pairs
from tracelab.session import ensure_checkpoint_dir
from tracelab.sources.artifacts import open_model, save_model
from tracelab.sources.datasets import read_dataset, select_split, with_split, write_splits
from tracelab.sources.jsonl import append_results, read_jsonl_tolerant
from tracelab.sources.shards import export_tensor_shards, import_tensor_shards, read_activations, shard_stats, write_activation_shards

register(
    "k4_sample_per_split",
    """SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|' || lang || '|42'), doc_id) AS r
  FROM documents) WHERE r <= 20""",
)(lambda spark, sf_dir: sample_n(table(spark, sf_dir, "documents"), 20, 42, "doc_id", by="lang").select("doc_id", "lang"))


def _k5(spark, sf_dir):
    pairs = conversation_pairs(table(spark, sf_dir, "conversations")).select(F.col("sample_id").alias("id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    m = mix_sources(pairs, docs, 0.8, "id", seed=42)
    return m.select("source", "id", r6("mix_position").alias("mix_position"))


def _sql_uniform(key: str, tag: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '|{tag}|42'), 1, 12))::BIGINT / 281474976710656.0)"


register(
    "k5_mix_sources",
    """WITH pairs AS (
  SELECT conv_id * 1000 + turn AS id FROM (
    SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations) WHERE role = 'user' AND nr = 'assistant'
)
SELECT 'reasoning' AS source, id, round("""
    + _sql_uniform("id", "r")
    + """ * ((SELECT count(*) FROM pairs) / 0.8), 6) AS mix_position FROM pairs
UNION ALL
SELECT 'general', doc_id, round("""
    + _sql_uniform("doc_id", "g")
    + """ * ((SELECT count(*) FROM documents) / (1 - 0.8::DOUBLE)), 6) FROM documents""",
)(_k5)

register(
    "k6_question_fallback",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents "
    "WHERE nullif(text, '') IS NOT NULL AND (('0x' || substr(md5(doc_id::VARCHAR || '|42'), 1, 12))::BIGINT / 281474976710656.0) < 0.1 "
    f"AND NOT regexp_matches(text, '(?s)<think>.*?</think>') AND NOT regexp_matches(text, '(?i){SOLUTION_HEADER}')",
)(
    lambda spark, sf_dir: question_fallback(table(spark, sf_dir, "documents"), "doc_id", 0.1, 42).select(
        "doc_id", F.md5("text").alias("text_md5")
    )
)

register("k7_global_shuffle", "SELECT doc_id, lang FROM documents")(
    lambda spark, sf_dir: global_shuffle(table(spark, sf_dir, "documents").select("doc_id", "lang"), 42, "doc_id")
)

register("k8_limit_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")(
    lambda spark, sf_dir: limit_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 100, [F.col("n_chars").desc(), "doc_id"])
)

register("k9_repeat_epochs", "SELECT e.epoch::INT AS epoch, vec_id FROM embeddings CROSS JOIN range(3) e(epoch)")(
    lambda spark, sf_dir: repeat_epochs(table(spark, sf_dir, "embeddings").select("vec_id"), 3, 42, "vec_id").select("epoch", "vec_id")
)

register("w3_assign_batches", "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 64)::BIGINT AS batch FROM embeddings")(
    lambda spark, sf_dir: assign_batches(table(spark, sf_dir, "embeddings").select("vec_id"), 64, "vec_id")
)


W6_SEED, W6_DRAWS, W6_BUCKETS = 7, 200, 8


def _w6(spark, sf_dir):
    params = fixture_params(sparse=True)
    rows = sae_forward_rows(table(spark, sf_dir, "embeddings"), params, "vec_id", "embedding")
    return sample_by_weight(rows, "r_sq", "vec_id", W6_DRAWS, W6_SEED, W6_BUCKETS)


def sql_draws(n: int, seed: int, buckets: int) -> str:
    """DuckDB fragment: ``drawn`` (draw, vec_id) from ``rowstats`` (vec_id, r_sq)."""
    return f"""
weighed AS (
  SELECT vec_id, r_sq AS w, ('0x' || substr(md5(vec_id::VARCHAR || '|{seed}|bucket'), 1, 8))::BIGINT % {buckets} AS b FROM rowstats WHERE r_sq > 0
),
shares AS (SELECT b, sum(w) AS s FROM weighed GROUP BY b),
ends AS (SELECT b, s, sum(s) OVER (ORDER BY b) AS hi, sum(s) OVER () AS total, max(b) OVER () AS last FROM shares),
u AS (SELECT i AS draw, ('0x' || substr(md5(i::VARCHAR || '|{seed}'), 1, 12))::BIGINT / 281474976710656.0 AS u FROM range({n}) t(i)),
placed AS (SELECT draw, b, u * total - (hi - s) AS rest FROM u JOIN ends ON u * total >= hi - s AND (u * total < hi OR b = last)),
inside AS (
  SELECT vec_id, b, sum(w) OVER (PARTITION BY b ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, w,
         row_number() OVER (PARTITION BY b ORDER BY vec_id DESC) = 1 AS last FROM weighed
),
drawn AS (SELECT draw, vec_id FROM placed JOIN inside USING (b) WHERE rest >= inside.hi - w AND (rest < inside.hi OR last))"""


register(
    "w6_sample_by_weight",
    "WITH "
    + sql_fixture_features(sparse=True)
    + sql_fixture_residuals()
    + ","
    + sql_draws(W6_DRAWS, W6_SEED, W6_BUCKETS)
    + "\nSELECT draw, vec_id FROM drawn",
)(_w6)

X12_EVERY = 5  # latents taken for dead: every fifth


def _x12(spark, sf_dir):
    """Dead latents and the rows whose residuals replace them."""
    params = fixture_params(sparse=True)
    rows = sae_forward_rows(table(spark, sf_dir, "embeddings"), params, "vec_id", "embedding", keep=("embedding",), with_x_hat=True)
    out = scratch_dir(spark, "forward")
    rows.write.parquet(out)
    dead = list(range(0, params.d_sae, X12_EVERY))
    got = residual_directions(spark.read.parquet(out), "embedding", "vec_id", len(dead), W6_SEED, W6_BUCKETS)
    return got.select(
        (F.col("draw") * X12_EVERY).alias("latent_id"), "vec_id", r6(F.col("direction")[0]).alias("first"), r6(F.col("direction")[63]).alias("last")
    )


register(
    "x12_resample_dead",
    "WITH "
    + sql_fixture_features(sparse=True)
    + sql_fixture_residuals()
    + ","
    + sql_draws(-(-256 // X12_EVERY), W6_SEED, W6_BUCKETS)
    + f"""
SELECT (draw * {X12_EVERY})::BIGINT AS latent_id, vec_id, round(max(CASE WHEN j = 0 THEN r END) / sqrt(any_value(r_sq)), 6) AS first,
       round(max(CASE WHEN j = 63 THEN r END) / sqrt(any_value(r_sq)), 6) AS last
FROM drawn JOIN res USING (vec_id) JOIN rowstats USING (vec_id) GROUP BY draw, vec_id""",
)(_x12)


def _x4(spark, sf_dir):
    """The initial latents for the width of the table's vectors."""
    d = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    lat = init_params_frame(spark, d, 4 * d, 42)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return lat.select("latent_id", r6(total("w_enc")).alias("sum_enc"), r6(F.col("w_enc")[0]).alias("first_enc"), r6(total("w_dec")).alias("sum_dec"), "b_enc")


register(
    "x4_init_params",
    """WITH size AS (SELECT max(len(embedding)) AS d FROM embeddings),
cells AS (
  SELECT i, j, d, (('0x' || substr(md5('42|1|' || i || '|' || j), 1, 12))::BIGINT + 0.5) / 281474976710656.0 * 2 - 1 AS e,
         (('0x' || substr(md5('42|2|' || i || '|' || j), 1, 12))::BIGINT + 0.5) / 281474976710656.0 * 2 - 1 AS f
  FROM (SELECT d, unnest(range(4 * d)) AS i FROM size), range(10000) t(j) WHERE j < d
)
SELECT i::BIGINT AS latent_id, round(sum(e / sqrt(4 * d)), 6) AS sum_enc, round(max(CASE WHEN j = 0 THEN e / sqrt(4 * d) END), 6) AS first_enc,
       round(sum(f) / sqrt(sum(f * f)), 6) AS sum_dec, 0.0::DOUBLE AS b_enc
FROM cells GROUP BY i""",
)(_x4)


def _w7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())
    out = interleave({lg: docs.filter(F.col("lang") == lg) for lg in langs}, "doc_id")
    return out.select("source", "rn", "doc_id")


register(
    "w7_interleave",
    """WITH r AS (SELECT lang AS source, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS rn, doc_id FROM documents)
SELECT * FROM r WHERE rn < (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))""",
)(_w7)


def _u1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    u = union_sources([docs, bench])
    return u.select("doc_id", F.md5("text").alias("text_md5"), "lang")


register(
    "u1_union_sources",
    "SELECT doc_id, md5(text) AS text_md5, lang FROM documents UNION ALL SELECT item_id, md5(text), NULL FROM benchmark",
)(_u1)


def _p15(spark, sf_dir):
    layers = layer_grid(layer_range="0:2", layer_step=2, final_layer=3)
    e = table(spark, sf_dir, "embeddings").withColumn("layer", (F.col("vec_id") % 4).cast("long"))
    return select_layers(e, layers).select("vec_id", "layer")


register("p15_layer_grid", "SELECT vec_id, (vec_id % 4)::BIGINT AS layer FROM embeddings WHERE vec_id % 4 IN (0, 2, 3)")(_p15)


def _x3(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    seq = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s"))
    seq = seq.select("conv_id", F.col("s.n").alias("ids"))
    b = assign_batches(seq, 8, "conv_id")
    p = pad_batch(b, "batch", "ids", 0)
    return p.select("conv_id", "batch", F.array_join("ids", ",").alias("ids"), F.array_join("attention_mask", ",").alias("mask"))


register(
    "x3_pad_batch",
    """WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ids FROM conversations GROUP BY conv_id),
b AS (SELECT *, ((row_number() OVER (ORDER BY conv_id) - 1) // 8)::BIGINT AS batch FROM s),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS mx FROM b)
SELECT conv_id, batch,
       array_to_string(list_concat(ids, list_transform(range(mx - len(ids)), lambda x: 0)), ',') AS ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(mx - len(ids)), lambda x: 0)), ',') AS mask
FROM m""",
)(_x3)


def _x8(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", bf16_round("embedding").alias("x"))
    return e.select("vec_id", F.posexplode("x").alias("dim", "value")).select("vec_id", F.col("dim").cast("long"), F.col("value").cast("double").alias("value"))


# A bfloat16 has 8 significant bits: the number in units of the last one, rounded half to even.
register(
    "x8_bf16_round",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
q AS (SELECT *, pow(2, floor(log2(abs(x))) - 7) AS q FROM x WHERE x <> 0)
SELECT vec_id, dim::BIGINT AS dim, round_even(x / q, 0) * q AS value FROM q
UNION ALL SELECT vec_id, dim, 0.0 FROM x WHERE x = 0""",
)(_x8)


register(
    "a21_sources_summary",
    "SELECT lang AS split, count(*)::BIGINT AS rows, 4::BIGINT AS columns FROM documents GROUP BY lang",
)(
    lambda spark, sf_dir: sources_summary(table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")).select(
        "split", F.col("rows").cast("long"), "columns"
    )
)


def _curve(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
    return train_curve(ev, "step", "loss", 100)


SQL_CURVE = """WITH c AS (
  SELECT ((event_id + 1 - 1) // 100)::BIGINT AS interval, avg(value) AS loss, max(event_id + 1) AS last_step FROM events GROUP BY 1
)"""

register("a17_train_curve", SQL_CURVE + "\nSELECT interval, round(loss, 6) AS loss, last_step FROM c")(
    lambda spark, sf_dir: _curve(spark, sf_dir).select("interval", r6("loss").alias("loss"), "last_step")
)

register(
    "w4_best_so_far",
    SQL_CURVE + "\nSELECT interval, round(min(loss) OVER (ORDER BY interval ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_loss FROM c",
)(lambda spark, sf_dir: best_so_far(_curve(spark, sf_dir), "interval", "loss").select("interval", r6("best_loss").alias("best_loss")))


# --- round trips through the shared folder (S1, S2, S4, S5, S6, S8) ---------------

SPLIT_OF_LANG = {"en": "train", "fr": "test", "de": "validation", "es": "dev"}


def scratch_dir(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def _split_dataset(spark, sf_dir) -> str:
    docs = table(spark, sf_dir, "documents")
    m = F.create_map(*[F.lit(x) for kv in SPLIT_OF_LANG.items() for x in kv])
    out = scratch_dir(spark, "dataset")
    write_splits(docs.withColumn("split", F.coalesce(m[F.col("lang")], F.lit("train"))), out)
    return out


def _s1(spark, sf_dir):
    back = read_dataset(spark, _split_dataset(spark, sf_dir), split=None)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


register(
    "s1_dataset_roundtrip",
    """SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' WHEN 'de' THEN 'validation' WHEN 'es' THEN 'dev' ELSE 'train' END AS split,
       count(*)::BIGINT AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""",
)(_s1)


def _s2(spark, sf_dir):
    """Rows by the split in the path of their file, for folders named by language."""
    docs = table(spark, sf_dir, "documents")
    out = scratch_dir(spark, "by-path")
    for lang, split in SPLIT_OF_LANG.items():
        docs.filter(F.col("lang") == lang).select("doc_id", "n_chars").write.json(posixpath.join(out, f"{split}-00000"))
    docs.filter(~F.col("lang").isin(*SPLIT_OF_LANG)).select("doc_id", "n_chars").write.json(posixpath.join(out, "rest"))
    rows = spark.read.schema("doc_id long, n_chars long").option("recursiveFileLookup", "true").json(out)
    return with_split(rows, out).select("doc_id", "split")


register(
    "s2_split_of_path",
    """SELECT doc_id, CASE lang WHEN 'fr' THEN 'test' WHEN 'de' THEN 'validation' WHEN 'es' THEN 'dev' ELSE 'train' END AS split
FROM documents WHERE lang IS NOT NULL""",
)(_s2)


def _s3(spark, sf_dir):
    """One split of a dataset, chosen while reading and chosen by rows."""
    out = _split_dataset(spark, sf_dir)
    read = read_dataset(spark, out, split="validation", with_split=False).select("doc_id", F.lit("read").alias("how"))
    rows = select_split(read_dataset(spark, out, split=None), "validation").select("doc_id", F.lit("rows").alias("how"))
    return read.union(rows)


register("s3_select_split", "SELECT doc_id, how FROM documents, (VALUES ('read'), ('rows')) h(how) WHERE lang = 'de'")(_s3)


def _s6(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 4).alias("layer"), F.col("embedding").alias("x")
    )
    out = scratch_dir(spark, "shards")
    write_activation_shards(e, out, seed=42, shard_mb=0.01, d_model=64)
    back = read_activations(spark, out, layer=2)
    stats = shard_stats(spark, out, batch_size=32).agg(F.sum("rows").alias("rows"), F.sum("batches").alias("batches"))
    got = back.agg(F.count(F.lit(1)).alias("layer_rows"), F.sum("row_id").alias("id_sum"))
    # two one-row aggregates side by side
    return got.crossJoin(F.broadcast(stats))


register(
    "s6_activation_shards",
    """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 2)::BIGINT AS layer_rows,
       (SELECT sum(vec_id) FROM embeddings WHERE vec_id % 4 = 2)::BIGINT AS id_sum,
       (SELECT count(*) FROM embeddings)::BIGINT AS rows,
       (SELECT sum(ceil(c / 32)) FROM (SELECT count(*) AS c FROM embeddings GROUP BY vec_id % 4))::BIGINT AS batches""",
)(_s6)


S7_SEED_ROWS = 150  # rows of a written shard


def _s7(spark, sf_dir):
    """Vectors to tensor shards and back, each file read by several tasks."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"))
    out = scratch_dir(spark, "tensors")
    export_tensor_shards(e, out, shard_rows=S7_SEED_ROWS)
    back = import_tensor_shards(spark, out, range_bytes=16 * 1024)
    return back.select(F.col("row_id").alias("vec_id"), F.size("x").cast("long").alias("width"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), F.col("x")[0].cast("double").alias("first"))


register(
    "s7_tensor_shards",
    "SELECT vec_id, len(embedding)::BIGINT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total, embedding[1]::DOUBLE AS first FROM embeddings",
)(_s7)


def _label_lines(spark, sf_dir, name: str) -> str:
    """The labels as JSON lines, a last line of one file cut short."""
    out = scratch_dir(spark, name)
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    lab.write.json(out)
    cut = lab.orderBy("doc_id").limit(1).select(F.substring(F.to_json(F.struct("doc_id", "quality")), 1, 12).alias("value"))
    cut.write.mode("append").option("lineSep", " ").text(out)
    return out


def _s9(spark, sf_dir):
    records, stats = read_jsonl_tolerant(spark, _label_lines(spark, sf_dir, "labels"), range_bytes=4096)
    rows = records.select(*[F.variant_get("record", f"$.{c}", "long").alias(c) for c in ("doc_id", "quality", "toxic")])
    cut = stats.agg(F.sum("skipped_invalid_lines").alias("n"))
    per = rows.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return per.unionByName(cut.select(F.lit(-1).cast("long").alias("quality"), F.lit(-1).cast("long").alias("toxic"), "n", F.lit(0).cast("long").alias("ids")))


register(
    "s9_jsonl_tolerant",
    """SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM labels GROUP BY 1, 2
UNION ALL SELECT -1, -1, 1, 0""",
)(_s9)


def _s10(spark, sf_dir):
    """Half of the labels written, then all resumed over them."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = scratch_dir(spark, "results")
    first = append_results(lab.filter("doc_id % 2 = 0"), out, ["doc_id"], "new")
    second = append_results(lab, out, ["doc_id"], "resume", range_bytes=4096)
    steps = [("new", first), ("resume", second)]
    counts = spark.createDataFrame([(n, r.written, r.recovered, r.skipped_invalid_lines, r.total) for n, r in steps], "step string, written long, recovered long, skipped long, total long")
    got = spark.read.schema("doc_id long, quality long").json(out)
    return counts.unionByName(got.agg(F.lit("file").alias("step"), F.count(F.lit(1)).alias("written"), F.countDistinct("doc_id").alias("recovered"), F.sum("quality").alias("skipped"), F.sum("doc_id").alias("total")))


register(
    "s10_append_results",
    """WITH c AS (SELECT count(*) AS n, count_if(doc_id % 2 = 0) AS even, sum(quality) AS q, sum(doc_id) AS ids FROM labels)
SELECT 'new' AS step, even::BIGINT AS written, 0::BIGINT AS recovered, 0::BIGINT AS skipped, even::BIGINT AS total FROM c
UNION ALL SELECT 'resume', (n - even)::BIGINT, even::BIGINT, 0, n::BIGINT FROM c
UNION ALL SELECT 'file', n::BIGINT, n::BIGINT, q::BIGINT, ids::BIGINT FROM c""",
)(_s10)


def _s13(spark, sf_dir):
    """A model saved, opened where it lies, and used: the top features of every vector."""
    out = scratch_dir(spark, "model")
    save_model(spark, fixture_params(sparse=True), out)
    feats = sae_features(table(spark, sf_dir, "embeddings"), open_model(spark, out), "vec_id", "embedding")
    return feats.select("vec_id", "latent_id", F.col("rank").cast("long"), r6("value").alias("value"))


register(
    "s13_saved_model",
    "WITH " + sql_fixture_features(sparse=True) + "\nSELECT vec_id, latent_id::BIGINT AS latent_id, rnk::BIGINT AS rank, round(v, 6) AS value FROM feats",
)(_s13)
