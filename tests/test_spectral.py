import math

import numpy as np
import pytest

from tripleval.operators import spectral


def _weights(spark, mats):
    rows = []
    for (model, variant, layer), m in mats.items():
        for i, row in enumerate(m):
            rows.append((model, variant, layer, i, [float(x) for x in row]))
    return spark.createDataFrame(rows, "model_id string, variant string, layer string, row_id int, "
                                       "values array<double>")


def test_identity_layer(spark):
    d = 6
    st = {r.metric: r.value for r in spectral.spectral_layer_stats(
        _weights(spark, {("m", "baseline", "l0"): np.eye(d)})).collect()}
    assert st["log_norm"] == pytest.approx(math.log10(d))
    assert st["log_spectral_norm"] == pytest.approx(0.0, abs=1e-9)
    assert st["stable_rank"] == pytest.approx(d)


def test_random_layer_matches_numpy(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(40, 12))
    st = {r.metric: r.value for r in spectral.spectral_layer_stats(
        _weights(spark, {("m", "baseline", "l0"): w})).collect()}
    s = np.linalg.svd(w, compute_uv=False) ** 2
    assert st["log_norm"] == pytest.approx(np.log10(s.sum()), abs=1e-6)
    assert st["log_spectral_norm"] == pytest.approx(np.log10(s.max()), abs=1e-6)
    assert st["stable_rank"] == pytest.approx(s.sum() / s.max(), abs=1e-6)
    assert st["alpha_weighted"] == pytest.approx(st["alpha"] * np.log10(s.max()), abs=1e-5)
    fro = spectral.frobenius_norm(_weights(spark, {("m", "baseline", "l0"): w})).first().frobenius_norm
    assert fro == pytest.approx(np.linalg.norm(w), abs=1e-6)


def test_power_law_alpha_recovers_exponent():
    rng = np.random.default_rng(1)
    a = 3.0
    x = (1 - rng.random(4000)) ** (-1 / (a - 1))  # Pareto with xmin=1, exponent a
    assert spectral.power_law_alpha(x) == pytest.approx(a, abs=0.25)


def test_trainable_share(spark):
    from tripleval.operators.runs import param_totals
    df = spark.createDataFrame([("m", "head", 300, True), ("m", "body", 7_700, False)],
                               "model_id string, name string, numel long, requires_grad boolean")
    r = param_totals(df).first()
    assert (r.total_params, r.trainable_params, r.trainable_pct) == (8_000, 300, 3.75)


def test_spectral_changes(spark):
    from tripleval.operators.compare import compare_spectra
    rows = [("m", "baseline", "alpha", 5.5), ("m", "finetuned", "alpha", 4.25), ("m", "baseline", "log_norm", 1.0),
            ("m", "finetuned", "stable_rank", 3.0), ("n", "baseline", "alpha", 2.0), ("n", "finetuned", "alpha", 2.5)]
    got = compare_spectra(spark.createDataFrame(rows, "model_id string, variant string, metric string, value double"))
    # a metric of one variant only has no change
    assert sorted((r.model_id, r.metric, r.baseline, r.finetuned, r.delta) for r in got.collect()) == [
        ("m", "alpha", 5.5, 4.25, -1.25), ("n", "alpha", 2.0, 2.5, 0.5)]


def test_tree_of_triangles_keeps_singular_values(spark):
    rng = np.random.default_rng(3)
    mats = {("m", "baseline", f"l{i}"): rng.normal(size=(15 + 40 * i, 5)) for i in range(6)}
    mats["m", "finetuned", "l0"] = rng.normal(size=(3, 5))      # fewer rows than columns
    mats["m", "finetuned", "l1"] = np.zeros((9, 5))
    # rows of all layers interleaved, in small Arrow batches: many triangles per layer
    rows = _weights(spark, mats).repartition(20, "row_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = rows.select(*spectral.LAYER, "values").mapInPandas(lambda it: spectral._triangles(it, 1), spectral.TRIANGLE)
        assert parts.count() > 5 * len(mats)
        folded = spectral.triangles(rows, fan_in=2, max_open_layers=1).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folded.groupby(spectral.LAYER).size().max() <= 4
    for key, g in folded.groupby(spectral.LAYER):
        got = np.linalg.svd(spectral._stacked(g), compute_uv=False)
        want = np.linalg.svd(mats[key], compute_uv=False)
        assert np.allclose(got[:len(want)], want, atol=1e-9) and np.allclose(got[len(want):], 0, atol=1e-9)


def test_small_singular_values_keep_their_digits():
    """Squaring the condition number would lose the smallest value."""
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(200, 4)))
    v, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = u @ np.diag([1.0, 1e-3, 1e-6, 1e-10]) @ v
    r = spectral.fold([spectral.fold([x[k:k + 50]]) for k in range(0, 200, 50)])
    assert np.linalg.svd(r, compute_uv=False)[-1] == pytest.approx(1e-10, rel=1e-4)


def test_wide_layer(spark):
    """1,024 columns: triangles travel as single rows."""
    rng = np.random.default_rng(5)
    w = rng.normal(size=(1500, 1024))
    df = spark.createDataFrame([(("m"), "baseline", "l0", i, x.tolist()) for i, x in enumerate(w)],
                               "model_id string, variant string, layer string, row_id int, values array<double>").repartition(3)
    st = {r.metric: r.value for r in spectral.spectral_layer_stats(df).collect()}
    s = np.linalg.svd(w, compute_uv=False) ** 2
    assert st["log_norm"] == pytest.approx(np.log10(s.sum()), abs=2e-6)
    assert st["stable_rank"] == pytest.approx(s.sum() / s.max(), abs=2e-6)


def test_runs_with_spectra(spark):
    runs = spark.createDataFrame([(1, "m", "success"), (2, "m", "failed"), (3, "n", "success"), (4, "o", "success")],
                                 "run_id long, model_id string, status string")
    changes = spark.createDataFrame([("m", "alpha_weighted", -1.5), ("m", "alpha", 2.0), ("n", "alpha", 1.0), ("o", "alpha_weighted", None)],
                                    "model_id string, metric string, delta double")
    got = spectral.filter_has_spectra(runs, changes).collect()
    assert [(r.run_id, r.model_id, r.alpha_weighted_delta) for r in got] == [(1, "m", -1.5)]
