"""Baseline vs trained comparison, leaderboards and formatted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ["baseline", "finetuned"]


def compare_variants(metrics: DataFrame) -> DataFrame:
    """Per (model, distribution, metric): baseline, finetuned, delta (null when a side is absent)."""
    wide = (metrics.groupBy("model_id", "distribution", "metric")
            .pivot("variant", VARIANTS).agg(F.first("value")))
    return wide.select("model_id", "distribution", "metric", "baseline", "finetuned",
                       F.round(F.col("finetuned") - F.col("baseline"), 6).alias("delta"))


def compare_spectra(spectra_summary: DataFrame) -> DataFrame:
    """Delta on the metric keys present in both variants only; one pass over the summary."""
    wide = spectra_summary.groupBy("model_id", "metric").pivot("variant", VARIANTS).agg(F.first("value"))
    return (wide.where(F.col("baseline").isNotNull() & F.col("finetuned").isNotNull())
            .withColumn("delta", F.round(F.col("finetuned") - F.col("baseline"), 6)))


def signed(delta: Column) -> Column:
    """``%+.4f``; a missing delta stays missing."""
    return F.when(delta.isNotNull(), F.format_string("%+.4f", delta))


def improvement_table(comparison: DataFrame, distribution: str = "id",
                      metrics=("rouge1", "rougeL", "bleu")) -> DataFrame:
    """Per model: delta of each metric, formatted ``%+.4f`` (ID distribution)."""
    sel = comparison.where((F.col("distribution") == distribution) & F.col("metric").isin(*metrics))
    wide = sel.groupBy("model_id").pivot("metric", list(metrics)).agg(F.first("delta"))
    return wide.select("model_id", *[signed(F.col(m)).alias(f"delta_{m}") for m in metrics])


def leaderboard(comparison: DataFrame, distribution: str = "id", metric: str = "bleu", k: int = 5) -> DataFrame:
    """Top-k models by improvement, descending (ties by model id): TakeOrderedAndProject."""
    return (comparison.where((F.col("distribution") == distribution) & (F.col("metric") == metric)
                             & F.col("delta").isNotNull())
            .select("model_id", "baseline", "finetuned", "delta")
            .orderBy(F.desc("delta"), F.asc("model_id")).limit(k))


def spectra_ranking(spectra_comparison: DataFrame, metric: str = "alpha_weighted") -> DataFrame:
    return (spectra_comparison.where(F.col("metric") == metric)
            .select("model_id", "baseline", "finetuned", "delta")
            .orderBy(F.asc("delta"), F.asc("model_id")))
