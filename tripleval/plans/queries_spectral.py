"""Registered queries: spectral statistics of weight tables, bootstrap intervals.

The SQL twin finds eigenvalues by one-sided Jacobi rotations in a recursive
CTE and fits the power law with joins.  The bootstrap draws its weights from md5, which both engines compute alike,
so it has an exact twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.models import alpha_band, finetune_quality_band, sql_alpha_band, sql_finetune_quality_band
from ..operators import compare, metrics, spectral
from ..operators.bootstrap import rouge_bootstrap, sql_poisson_weight, sql_uniform_from_md5
from ..sources import fixtures
from . import evaluate as ev
from .oracle import sql
from .registry import examples, register


def _layer_stats(spark, d):
    return spectral.spectral_layer_stats(fixtures.weights(spark, d))


def _spectra_cmp(spark, d):
    return compare.compare_spectra(spectral.spectral_summary(_layer_stats(spark, d)))


@register("frobenius_norm", sql("""SELECT model_id, variant, layer,
    round(sqrt(sum(list_sum(list_transform("values", lambda x: x * x)))), 6) AS frobenius_norm
    FROM weights GROUP BY ALL""", "weights"))
def q_frobenius_norm(spark, d):
    return spectral.frobenius_norm(fixtures.weights(spark, d))


@register("spectral_layer_stats", sql("SELECT * FROM layer_stats", "layer_stats"))
def q_spectral_layer_stats(spark, d):
    return _layer_stats(spark, d)


@register("spectral_summary", sql("SELECT * FROM spectra", "spectra"))
def q_spectral_summary(spark, d):
    return spectral.spectral_summary(_layer_stats(spark, d))


@register("compare_spectra", sql("SELECT * FROM spectra_cmp", "spectra_cmp"))
def q_compare_spectra(spark, d):
    return _spectra_cmp(spark, d)


@register("spectra_ranking", sql("""SELECT model_id, baseline, finetuned, delta FROM spectra_cmp
    WHERE metric = 'alpha_weighted'""", "spectra_cmp"))
def q_spectra_ranking(spark, d):
    return compare.spectra_ranking(_spectra_cmp(spark, d))


@register("alpha_band", sql(f"""SELECT model_id, variant, layer, value AS alpha, {sql_alpha_band('value')} AS band
    FROM layer_stats WHERE metric = 'alpha'""", "layer_stats"))
def q_alpha_band(spark, d):
    st = _layer_stats(spark, d).where(F.col("metric") == "alpha")
    return st.select("model_id", "variant", "layer", F.col("value").alias("alpha"),
                     alpha_band(F.col("value")).alias("band"))


@register("finetune_quality_band", sql(f"""SELECT model_id, delta, {sql_finetune_quality_band('delta')} AS quality
    FROM spectra_cmp WHERE metric = 'alpha_weighted'""", "spectra_cmp"))
def q_finetune_quality_band(spark, d):
    c = _spectra_cmp(spark, d).where(F.col("metric") == "alpha_weighted")
    return c.select("model_id", "delta", finetune_quality_band(F.col("delta")).alias("quality"))


@register("filter_has_spectra", sql("""SELECT run_id, r.model_id, status, delta AS alpha_weighted_delta FROM runs r
    JOIN spectra_cmp c ON c.model_id = r.model_id WHERE status = 'success' AND metric = 'alpha_weighted'""", "runs", "spectra_cmp"))
def q_filter_has_spectra(spark, d):
    """Successful runs of models that carry a spectral change (alpha_weighted delta)."""
    return spectral.filter_has_spectra(fixtures.runs(spark, d), _spectra_cmp(spark, d)) \
        .select("run_id", "model_id", "status", "alpha_weighted_delta")


def _bootstrap_sql(replicates: int = 200, seed: int = 42) -> str:
    u = sql_uniform_from_md5([str(seed), "r.rep", "e.distribution", "e.example_id"])
    metric_rows = " UNION ALL ".join(
        f"SELECT model_id, variant, distribution, rep, '{m}' AS metric, sum(w * {m}) / sum(w) AS m "
        f"FROM wx GROUP BY ALL HAVING sum(w) > 0" for m in metrics.ROUGE_KEYS)
    mean_rows = " UNION ALL ".join(
        f"SELECT model_id, variant, distribution, '{m}' AS metric, avg({m}) AS mean FROM ex_scores GROUP BY ALL"
        for m in metrics.ROUGE_KEYS)
    return sql(f"""SELECT p.model_id, p.variant, p.distribution, p.metric,
        round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid,
        round(quantile_cont(m, 0.975), 6) AS high, round(any_value(mn.mean), 6) AS mean
        FROM (WITH wx AS (SELECT e.*, r.rep, {sql_poisson_weight(u)} AS w
                          FROM ex_scores e, range(0, {replicates}) r(rep))
              {metric_rows}) p
        JOIN ({mean_rows}) mn USING (model_id, variant, distribution, metric)
        GROUP BY p.model_id, p.variant, p.distribution, p.metric""", "ex_scores")


@register("rouge_bootstrap", _bootstrap_sql())
def q_rouge_bootstrap(spark, d):
    preds = ev.predictions(examples(spark, d))
    scores = metrics.example_scores(metrics.example_stats(preds, metrics.ROUGE_KEYS))
    return rouge_bootstrap(scores, ["distribution", "example_id"], metrics.ROUGE_KEYS)
