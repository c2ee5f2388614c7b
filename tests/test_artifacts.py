"""Model / geometry artifacts and bf16 storage rounding."""

import numpy as np
from pyspark.sql import functions as F

from tracelab.functions.vectors import bf16_round
from tracelab.operators.sae import fixture_params
from tracelab.operators.scoring import score_behavior
from tracelab.operators.sae import sae_features
from tracelab.sources.artifacts import behavior_summary_records, load_model, read_geometry, save_model, write_geometry


def test_model_round_trip(spark, tmp_path):
    p = fixture_params()
    p.step = 7
    p.best_l2_ratio = 0.25
    p.steps_since[:3] = 11
    save_model(spark, p, str(tmp_path / "m"))
    q = load_model(spark, str(tmp_path / "m"), budget=50_000)  # several jobs
    assert q.step == 7 and q.best_l2_ratio == 0.25 and q.k == p.k
    assert np.allclose(q.w_enc, p.w_enc) and np.allclose(q.w_dec, p.w_dec) and (q.steps_since == p.steps_since).all()


def test_geometry_round_trip(spark, tmp_path):
    p = fixture_params()
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    st = score_behavior(sae_features(emb, p, "vec_id", "embedding", keep=("label",)), p.d_sae, 5)
    summary = behavior_summary_records(st["top"])
    pts = st["assignments"].select(
        "feature_index", F.col("assigned_label").cast("string"), "specificity", "mean_activation", F.lit(0.0).alias("x"), F.lit(1.0).alias("y")
    )
    write_geometry(summary, pts, str(tmp_path / "g"))
    s2, p2 = read_geometry(spark, str(tmp_path / "g"))
    assert s2.count() == summary.count() and p2.count() == pts.count()
    assert len(s2.first().top_features) == 5


def test_bf16_matches_numpy(spark):
    vals = np.array([1.0, 1.00390625, 1.0048828125, -3.14159, 65504.0, 1e-8, 0.0], dtype=np.float32)
    df = spark.createDataFrame([([float(v) for v in vals],)], "x array<float>")
    got = np.array(df.select(bf16_round("x")).first()[0], dtype=np.float32)
    bits = vals.view(np.uint32).astype(np.uint64)
    want = (((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)
    assert np.array_equal(got, want)
    assert got[1] == np.float32(1.0) and got[2] == np.float32(1.0078125)
    odd = spark.createDataFrame([(None,), ([],), ([float("nan"), None, 1.00390625],)], "x array<float>")
    got = [r[0] for r in odd.coalesce(1).select(bf16_round("x")).collect()]
    assert got[0] is None and got[1] == [] and np.isnan(got[2][0]) and got[2][1:] == [None, 1.0]
