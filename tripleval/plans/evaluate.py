"""Composite plans: prepare examples, evaluate baseline and trained variants.

One Catalyst plan covers all models: the model list becomes a generated
column, so scoring is one grouped aggregation over every model rather than a
job per model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import compare_spectra, compare_variants
from ..operators.generate import (KEY, MAX_NEW_WORDS, NATIVE_GENERATORS, GeneratorFactory, generate_native,
                                  generate_native_variants, generate_with, generate_with_variants, to_predictions,
                                  validation_inputs)
from ..operators.metrics import ALL_METRICS, Scorer, metric_bundle, reference_tokens, scored_means
from ..operators.retrieve import fit_answerer
from ..operators.spectral import spectral_layer_stats, spectral_summary
from ..operators.split import assemble_datasets, seeded_split
from ..operators.triplets import facts_to_triplets, parse_prompt, render_prompt
from ..session import shuffle_partitions, write_table
from ..sources import fixtures

SEED = 42
VAL_FRACTION = 0.30


def id_examples(spark: SparkSession, sf_dir: str, seed: int = SEED, val_fraction: float = VAL_FRACTION) -> DataFrame:
    """documents -> triplets -> seeded split -> rendered prompts."""
    # the split finds its threshold on the id column alone; the texts are read once
    return render_prompt(seeded_split(fixtures.id_triplets(spark, sf_dir), "triplet_id", seed, val_fraction))


def od_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_prompt(facts_to_triplets(fixtures.facts(spark, sf_dir)))


def examples(spark: SparkSession, sf_dir: str, seed: int = SEED, val_fraction: float = VAL_FRACTION,
             materialize: bool = True) -> DataFrame:
    """All examples with their split.  Materialised (partitioned by split) because the
    train, validation, generation and retrieval branches all read it."""
    ex = assemble_datasets(id_examples(spark, sf_dir, seed, val_fraction), od_examples(spark, sf_dir))
    if not materialize:
        return ex
    # ``text`` is prompt + response: derived on read instead of stored twice
    cols = ex.columns
    stored = write_table(ex.drop("text"), "examples", ["split"], codec="zstd")
    return stored.withColumn("text", F.concat("prompt", "response")).select(*cols)


@dataclass
class Evaluation:
    predictions: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    spectra: DataFrame | None = None      # compare_spectra, where weights are given


def answered_inputs(examples_df: DataFrame, materialize: bool = False) -> DataFrame:
    """Validation inputs with the trained answerer's retrieved answer (null when none).

    The answerer is fitted on the train split once; it does not depend on the
    generator, so a fleet shares this table across its models.
    """
    parsed = parse_prompt(examples_df)
    inputs = validation_inputs(parsed)
    train = parsed.where(F.col("split") == "train").select(
        "example_id", "observations", F.col("reference").alias("response"))
    hits = fit_answerer(train).retrieve(inputs).select(*KEY, "answer")
    # Generation and scoring are CPU-bound and small in bytes: the session's full number
    # of partitions keeps them spread over every core (AQE would coalesce them), and the
    # join with the hits reuses this partitioning.
    n = shuffle_partitions(examples_df.sparkSession)
    out = inputs.repartition(n, *KEY).join(hits, KEY, "left")
    return write_table(out, "answered-inputs") if materialize else out


def predictions(examples_df: DataFrame, models: Sequence[str] = NATIVE_GENERATORS,
                skip_finetuning: bool = False, answered: DataFrame | None = None,
                generators: Mapping[str, GeneratorFactory] | None = None, max_new_words: int = MAX_NEW_WORDS) -> DataFrame:
    """Predictions of every model in both variants (baseline only with ``skip_finetuning``).

    A model of ``generators`` (model id -> factory) runs over Arrow batches; the
    others are native generators, which share one plan.
    """
    generators = {m: g for m, g in (generators or {}).items() if m in models}
    native = [m for m in models if m not in generators]
    if skip_finetuning:
        inputs = validation_inputs(parse_prompt(examples_df))
        parts = [to_predictions(generate_native(inputs, native, max_new_words), "baseline")] if native else []
        parts += [to_predictions(generate_with(inputs, m, g), "baseline") for m, g in generators.items()]
        return reduce(DataFrame.unionByName, parts)
    with_answer = answered if answered is not None else answered_inputs(examples_df, materialize=bool(generators))
    parts = [to_predictions(generate_with_variants(with_answer, m, g)) for m, g in generators.items()]
    if not native:
        return reduce(DataFrame.unionByName, parts)
    # references are tokenised once per example, before the fan-out to models and variants
    with_tokens = reference_tokens(with_answer)
    carry = [c for c in with_tokens.columns if c not in with_answer.columns]
    preds = to_predictions(generate_native_variants(with_tokens, native, carry, max_new_words), carry=carry)
    if not parts:
        return preds
    return reduce(DataFrame.unionByName, parts, preds.drop(*carry))


def evaluate_models(examples_df: DataFrame, models: Sequence[str] = NATIVE_GENERATORS,
                    skip_finetuning: bool = False, metrics=ALL_METRICS,
                    generators: Mapping[str, GeneratorFactory] | None = None,
                    scorers: Mapping[str, Scorer] | None = None, weights: DataFrame | None = None,
                    max_new_words: int = MAX_NEW_WORDS) -> Evaluation:
    """Predictions, metrics and comparison of all models.  ``scorers`` are further metrics: name -> column
    expression over (prediction, reference), averaged over the examples.  With ``weights`` (model_id, variant,
    layer, values), the spectral changes of the models among them come along."""
    preds = predictions(examples_df, models, skip_finetuning, generators=generators, max_new_words=max_new_words)
    m = metric_bundle(preds, metrics)
    if scorers:
        m = m.unionByName(scored_means(preds, scorers))
    return Evaluation(preds, m, compare_variants(m), None if weights is None else spectral_changes(weights, models))


def spectral_changes(weights: DataFrame, models: Sequence[str]) -> DataFrame:
    """Spectral metrics of both variants and their difference, for the models that have weights."""
    stats = spectral_layer_stats(weights.where(F.col("model_id").isin(*models)))
    return compare_spectra(spectral_summary(stats))
