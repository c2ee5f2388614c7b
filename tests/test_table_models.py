"""Models as tables: streamed past the rows, fitted where they lie; variances at a large mean."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sae import _batch, _numpy_forward, _random_params

from tracelab.operators import sae, table_fit
from tracelab.operators.fit import fit_sae, residual_directions
from tracelab.operators.sae import fixture_params, latents_frame, list_matrix, sae_features, sae_forward_rows, store_params
from tracelab.operators.stats import batch_losses, recon_metrics
from tracelab.operators.table_fit import TableModel, fit_table
from tracelab.sources.artifacts import load_model, load_optimizer, open_model, save_model

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sae, "BLOCK_BYTES", 8 * 64 * 37)  # a block of 37 latents


def test_stored_model_equals_broadcast(spark, small_blocks):
    p = fixture_params(sparse=True)
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    stored = store_params(spark, p)
    key = lambda r: (r.vec_id, r.rank)
    a = sorted(sae_features(emb, p, "vec_id", "embedding").collect(), key=key)
    b = sorted(sae_features(emb, stored, "vec_id", "embedding").collect(), key=key)
    assert [(r.vec_id, r.rank, r.latent_id) for r in a] == [(r.vec_id, r.rank, r.latent_id) for r in b]
    assert np.allclose([r.value for r in a], [r.value for r in b])
    rows = [sae_forward_rows(emb, m, "vec_id", "embedding", with_x_hat=True).orderBy("vec_id").collect() for m in (p, stored)]
    assert all(np.allclose(x.x_hat, y.x_hat) and x.l0 == y.l0 for x, y in zip(*rows))
    plan = sae_forward_rows(emb, p, "vec_id", "embedding", budget=40 * 1024)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Window" not in plan


def test_batch_losses_of_a_stored_model(spark, small_blocks):
    p = fixture_params()
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("batch", F.expr("vec_id div 100"))
    a, b = (sorted(map(tuple, batch_losses(emb, m, "batch", "embedding").collect())) for m in (p, store_params(spark, p)))
    assert len(a) == 5 and np.allclose(a, b)


def test_saved_model_is_used_where_it_lies(spark, tmp_path):
    p = fixture_params()
    save_model(spark, p, str(tmp_path / "m"))
    m = open_model(spark, str(tmp_path / "m"))
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").limit(20)
    assert (m.d_model, m.d_sae, m.k) == (64, 256, 8)
    got = {r.vec_id: r.topk_ids for r in sae_forward_rows(emb, m, "vec_id", "embedding").collect()}
    assert got == {r.vec_id: r.topk_ids for r in sae_forward_rows(emb, p, "vec_id", "embedding").collect()}


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_explained_variance_at_a_large_mean(spark, shift):
    rng = np.random.default_rng(5)
    x = shift + rng.normal(size=(300, 16))
    r = rng.normal(size=(300, 16)) * 0.3
    hat = x - r
    around = lambda m: float(((m - m.mean()) ** 2).sum())
    rows = [(i, i % 3, float(a.sum()), float((a * a).sum()), around(a), float(b.sum()), float((b * b).sum()), around(b), 4) for i, (a, b) in enumerate(zip(x, x - hat))]
    df = spark.createDataFrame(rows, "id long, g int, x_sum double, x_sq double, x_m2 double, r_sum double, r_sq double, r_m2 double, l0 int").repartition(7)
    want = 1 - np.var(x - hat, ddof=1) / np.var(x, ddof=1)
    assert recon_metrics(df, 16).first().explained_variance == pytest.approx(want, rel=1e-9)
    for got in recon_metrics(df, 16, by="g").collect():
        of = np.arange(300) % 3 == got.g
        assert got.explained_variance == pytest.approx(1 - np.var((x - hat)[of], ddof=1) / np.var(x[of], ddof=1), rel=1e-9)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(shift + rng.normal(size=(50, 64)))], "id long, x array<double>")
    p = _random_params()
    p.b_dec[:] = shift
    m = recon_metrics(sae_forward_rows(vectors, p, "id", "x"), 64).first()
    xs = np.array([r.x for r in vectors.collect()])
    _, _, x_hat = _numpy_forward(xs, p)
    assert m.explained_variance == pytest.approx(1 - np.var(xs - x_hat, ddof=1) / np.var(xs, ddof=1), rel=1e-6)


def test_table_fit_equals_driver_fit(spark):
    _, df = _batch(spark, n=80)
    kw = {"batch_size": 32, "lr": 5e-3, "warmup_steps": 2, "total_steps": 8, "shuffle": True, "log_interval": 2, "weight_decay": 0.01}
    p = _random_params(d_sae=96)
    model = TableModel.start(latents_frame(spark, p), {0: p.b_dec}, p.k)
    log = fit_table(df, model, "x", "id", steps=4, **kw)
    q, want, _ = fit_sae(df, p, "x", "id", steps=4, **kw)
    got = model.latents().orderBy("latent_id").toArrow()
    for a, b in ((list_matrix(got["w_enc"]).T, q.w_enc), (list_matrix(got["w_dec"]), q.w_dec), (got["b_enc"].to_numpy(), q.b_enc), (model.fits[0].b_dec, q.b_dec)):
        assert np.abs(a - b).max() < 1e-9
    assert (got["steps_since"].to_numpy() == q.steps_since).all() and (got["activation_count"].to_numpy() == q.activation_count).all()
    for m, w in zip(log, want, strict=True):
        assert all(m[k] == pytest.approx(w[k], abs=1e-9) for k in w)
    assert model.fits[0].best_l2_ratio == pytest.approx(q.best_l2_ratio)


def test_table_fit_saved_and_resumed(spark, tmp_path):
    _, df = _batch(spark, n=64)
    kw = {"batch_size": 32, "lr": 5e-3, "total_steps": 4}
    p = _random_params(d_sae=96)
    whole = TableModel.start(latents_frame(spark, p), {0: p.b_dec}, p.k)
    fit_table(df, whole, "x", "id", steps=4, **kw)
    half = TableModel.start(latents_frame(spark, p), {0: p.b_dec}, p.k)
    fit_table(df, half, "x", "id", steps=2, checkpoint_dir=str(tmp_path), **kw)
    at = str(tmp_path / "checkpoint_final")
    read, state = load_model(spark, at), load_optimizer(spark, at)
    assert read.step == state.t == 2 and read.d_sae == 96 and open_model(spark, at).d_sae == 96
    again = TableModel.resume(spark, at)
    fit_table(df, again, "x", "id", steps=2, **kw)
    a, b = (m.latents().orderBy("latent_id").toArrow() for m in (whole, again))
    for c in ("w_enc", "w_dec", "m_enc", "v_dec"):
        assert np.abs(list_matrix(a[c]) - list_matrix(b[c])).max() < 1e-12
    assert np.abs(whole.fits[0].b_dec - again.fits[0].b_dec).max() < 1e-12


def test_layers_are_fitted_together(spark, monkeypatch):
    _, df = _batch(spark, n=90)
    df = df.withColumn("layer", F.when(F.col("id") < 50, 3).otherwise(7))
    p = _random_params(d_sae=64)
    start = lambda: TableModel.start(latents_frame(spark, p), {3: p.b_dec, 7: p.b_dec}, p.k)
    kw = {"batch_size": 20, "lr": 5e-3, "total_steps": 3}
    model = start()
    log = fit_table(df, model, "x", "id", fit_col="layer", **kw)
    assert sorted((m["fit"], m["step"], m["n_rows"]) for m in log) == [(3, 1, 20), (3, 2, 20), (3, 3, 10), (7, 1, 20), (7, 2, 20)]
    for layer in (3, 7):
        q, _, _ = fit_sae(df.filter(F.col("layer") == layer), p.copy(), "x", "id", None, **kw)
        got = model.latents().filter(F.col("fit") == layer).orderBy("latent_id").toArrow()
        assert np.abs(list_matrix(got["w_enc"]).T - q.w_enc).max() < 1e-9
    jobs = []
    monkeypatch.setattr(table_fit, "find_top", lambda m, step, run=table_fit.find_top: (jobs.append(len(step)), run(m, step)))
    fit_table(df, start(), "x", "id", steps=2, fit_col="layer", **kw)
    assert jobs == [2, 2]  # both layers in each pass


def test_table_fit_resamples_dead_latents(spark):
    _, df = _batch(spark, n=64)
    p = _random_params(d_sae=128)
    p.steps_since[:] = 20000
    model = TableModel.start(latents_frame(spark, p), {0: p.b_dec}, p.k)
    log = fit_table(df, model, "x", "id", steps=1, batch_size=32, dead_check_interval=1)
    got = model.latents().filter("steps_since = 0 AND activation_count = 0").collect()
    assert len(got) == log[0]["resampled"] > 0
    assert all(np.isclose(np.linalg.norm(r.w_enc), 1) and r.w_enc == r.w_dec and r.b_enc == 0 for r in got)


def test_residual_directions(spark):
    p = fixture_params(sparse=True)
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    rows = sae_forward_rows(emb, p, "vec_id", "embedding", keep=("embedding",), with_x_hat=True).cache()
    got = residual_directions(rows, "embedding", "vec_id", 40, 3, buckets=4).collect()
    of = {r.vec_id: np.array(r.embedding) - np.array(r.x_hat) for r in rows.collect()}
    rows.unpersist()
    assert sorted(r.draw for r in got) == list(range(40))
    assert all(np.allclose(r.direction, of[r.vec_id] / np.linalg.norm(of[r.vec_id])) for r in got)


def test_a_stretch_of_steps_is_the_same_as_single_steps(spark, monkeypatch, tmp_path):
    """Epochs of a new order, two layers of unequal length, dead latents reset, a checkpoint on the way."""
    _, df = _batch(spark, n=90)
    df = df.withColumn("layer", F.when(F.col("id") < 50, 3).otherwise(7))
    p = _random_params(d_sae=64)
    kw = {"steps": 9, "batch_size": 20, "fit_col": "layer", "lr": 5e-3, "warmup_steps": 2, "weight_decay": 0.01, "shuffle": True, "log_interval": 2}
    kw |= {"dead_threshold": 1, "dead_check_interval": 3, "resample_trigger": 0.01, "checkpoint_interval": 4}
    jobs, got = [], []
    monkeypatch.setattr(table_fit, "_stretch", lambda m, steps, *a, run=table_fit._stretch: (jobs.append(steps), run(m, steps, *a))[1])
    for least in (8, 100):
        monkeypatch.setattr(table_fit, "STRETCH_STEPS", least)
        model = TableModel.start(latents_frame(spark, p), {3: p.b_dec, 7: p.b_dec}, p.k)
        log = fit_table(df, model, "x", "id", checkpoint_dir=str(tmp_path / str(least)), **kw)
        got.append((log, model.latents().orderBy("fit", "latent_id").toArrow(), model.fits))
    assert [sorted(x.items()) for x in jobs] == [[(3, 3), (7, 2)], [(3, 1), (7, 2)], [(3, 2), (7, 2)], [(3, 2), (7, 2)], [(3, 1), (7, 1)]]
    (log, rows, fits), (log1, rows1, fits1) = got
    assert [(m["fit"], m["step"]) for m in log] == [(m["fit"], m["step"]) for m in log1] and sum(m.get("resampled", 0) for m in log) > 0
    for m, w in zip(log, log1, strict=True):
        assert m.keys() == w.keys() and all(m[c] == pytest.approx(w[c], abs=1e-9) for c in w)
    for c in ("w_enc", "w_dec", "m_enc", "v_dec"):
        assert np.abs(list_matrix(rows[c]) - list_matrix(rows1[c])).max() < 1e-9
    for c in ("latent_id", "steps_since", "activation_count"):
        assert rows[c].to_pylist() == rows1[c].to_pylist()
    assert all(np.abs(fits[f].b_dec - fits1[f].b_dec).max() < 1e-9 and fits[f].best_l2_ratio == pytest.approx(fits1[f].best_l2_ratio) for f in (3, 7))
    assert open_model(spark, str(tmp_path / "8" / "checkpoint_4" / "fit_7")).d_sae == 64
