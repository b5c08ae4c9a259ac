"""Registered queries: triplets, prompts, split, generation, metrics, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import render_inference_prompt, sql_render_inference_prompt
from ..operators import compare, generate, metrics, retrieve
from ..operators.split import seeded_split, split_counts
from ..operators.triplets import facts_to_triplets, parse_prompt
from ..sources import fixtures
from . import evaluate as ev
from .oracle import sql
from .registry import evaluation, examples, register

KEY4 = ["model_id", "variant", "distribution", "example_id"]


@register("seeded_split", sql("SELECT triplet_id, form, split FROM id_split", "id_split"))
def q_seeded_split(spark, d):
    return seeded_split(fixtures.id_triplets(spark, d), "triplet_id").select("triplet_id", "form", "split")


@register("facts_to_triplets", sql("SELECT * FROM od_trip", "od_trip"))
def q_facts_to_triplets(spark, d):
    return facts_to_triplets(fixtures.facts(spark, d))


@register("render_prompt", sql("SELECT example_id, dataset, form, split, prompt, response, prompt || response AS text "
                               "FROM id_ex", "id_ex"))
def q_render_prompt(spark, d):
    return ev.id_examples(spark, d)


@register("assemble_datasets", sql("SELECT example_id, dataset, form, split, prompt, response, text FROM examples",
                                   "examples"))
def q_assemble_datasets(spark, d):
    return examples(spark, d).select("example_id", "dataset", "form", "split", "prompt", "response", "text")


@register("split_counts", sql("SELECT split, count(*) AS n FROM examples GROUP BY split", "examples"))
def q_split_counts(spark, d):
    return split_counts(examples(spark, d))


@register("parse_prompt", sql("SELECT example_id, dataset, split, observations, question, reference, parse_ok "
                              "FROM parsed", "parsed"))
def q_parse_prompt(spark, d):
    return parse_prompt(examples(spark, d)).select("example_id", "dataset", "split", "observations", "question",
                                                   "reference", "parse_ok")


@register("render_inference_prompt", sql(
    "SELECT distribution, example_id, " + sql_render_inference_prompt("observations", "question")
    + " AS prompt FROM inputs", "inputs"))
def q_render_inference_prompt(spark, d):
    inputs = generate.validation_inputs(parse_prompt(examples(spark, d)))
    return inputs.select("distribution", "example_id",
                         render_inference_prompt(F.col("observations"), F.col("question")).alias("prompt"))


def _inputs(spark, d):
    return generate.validation_inputs(parse_prompt(examples(spark, d)))


@register("cross_models_examples", sql("SELECT m.model_id, distribution, example_id FROM inputs, "
                                       "(VALUES ('lead'), ('last_line'), ('echo')) m(model_id)", "inputs"))
def q_cross_models_examples(spark, d):
    return generate.cross_models_examples(_inputs(spark, d), generate.NATIVE_GENERATORS).select(
        "model_id", "distribution", "example_id")


@register("generate_answers", sql("SELECT model_id, distribution, example_id, full_text FROM base_gen", "base_gen"))
def q_generate_answers(spark, d):
    return generate.generate_native(_inputs(spark, d), generate.NATIVE_GENERATORS).select(
        "model_id", "distribution", "example_id", "full_text")


def _echo_factory():
    """A stand-in model: the prompt, then the question's words."""
    def fn(batch):
        words = batch["question"].str.split().str[:generate.MAX_NEW_WORDS].str.join(" ")
        return batch["prompt"] + words + "\n" + generate.END_MARK
    return fn


@register("generate_answers_batches", sql("SELECT model_id, distribution, example_id, full_text FROM base_gen WHERE model_id = 'echo'",
                                          "base_gen"))
def q_generate_answers_batches(spark, d):
    """A pluggable model over Arrow batches."""
    return generate.generate_with(_inputs(spark, d), "echo", _echo_factory).select(
        "model_id", "distribution", "example_id", "full_text")


@register("extract_answer", sql("SELECT model_id, variant, distribution, example_id, prediction FROM preds "
                                "WHERE variant = 'baseline'", "preds"))
def q_extract_answer(spark, d):
    gen = generate.generate_native(_inputs(spark, d), generate.NATIVE_GENERATORS)
    return generate.to_predictions(gen, "baseline").select(*KEY4, "prediction")


@register("fit_answerer", sql("SELECT distribution, example_id, train_id, score, answer FROM hits", "hits"))
def q_fit_answerer(spark, d):
    parsed = parse_prompt(examples(spark, d))
    train = parsed.where(F.col("split") == "train").select("example_id", "observations",
                                                           F.col("reference").alias("response"))
    return retrieve.fit_answerer(train).retrieve(generate.validation_inputs(parsed))


@register("join_predictions_references", sql(
    "SELECT model_id, variant, distribution, example_id, observations, question, reference, prediction FROM preds",
    "preds"))
def q_join_predictions_references(spark, d):
    ex = examples(spark, d)
    preds = ev.predictions(ex).select(*KEY4, "prediction")
    return generate.join_predictions_references(preds, generate.validation_inputs(parse_prompt(ex)))


def _metric_sql(name: str) -> str:
    return sql(f"SELECT * FROM metrics WHERE metric = '{name}'", "metrics")


def _metric_query(name: str):
    def q(spark, d):
        return metrics.metric_bundle(ev.predictions(examples(spark, d)), [name])
    q.__name__ = f"q_{name}"
    return q


for _m in ["rouge1", "rouge2", "rougeL", "bleu"]:
    register(_m, _metric_sql(_m))(_metric_query(_m))


@register("rougeLsum", sql("""SELECT model_id, variant, distribution, 'rougeLsum' AS metric,
    round(avg(rougeLsum), 6) AS value, count(*) AS n_examples FROM lsum_scores GROUP BY ALL""", "lsum_scores"))
def q_rouge_lsum(spark, d):
    """Summary-level ROUGE-L on conversation triplets, whose references span several lines."""
    conv = fixtures.conversation_triplets(spark, d)
    inputs = conv.select(F.lit("conv").alias("distribution"), F.col("triplet_id").alias("example_id"),
                         "observations", "question", F.col("answer").alias("reference"))
    gen = generate.generate_native(inputs, generate.NATIVE_GENERATORS)
    return metrics.metric_bundle(generate.to_predictions(gen, "baseline"), ["rougeLsum"])


@register("metric_bundle", sql("SELECT * FROM metrics WHERE variant = 'baseline'", "metrics"))
def q_metric_bundle(spark, d):
    return metrics.metric_bundle(ev.predictions(examples(spark, d), skip_finetuning=True))


@register("evaluate_models", sql("SELECT * FROM metrics", "metrics"))
def q_evaluate_models(spark, d):
    return evaluation(spark, d).metrics


@register("compare_variants", sql("SELECT * FROM comparison", "comparison"))
def q_compare_variants(spark, d):
    return evaluation(spark, d).comparison


@register("improvement_table", sql("""SELECT model_id,
    printf('%+.4f', max(CASE WHEN metric = 'rouge1' THEN delta END)) AS delta_rouge1,
    printf('%+.4f', max(CASE WHEN metric = 'rougeL' THEN delta END)) AS delta_rougeL,
    printf('%+.4f', max(CASE WHEN metric = 'bleu' THEN delta END)) AS delta_bleu
    FROM comparison WHERE distribution = 'id' GROUP BY model_id""", "comparison"))
def q_improvement_table(spark, d):
    return compare.improvement_table(evaluation(spark, d).comparison)


@register("leaderboard", sql("""SELECT model_id, baseline, finetuned, delta FROM comparison
    WHERE distribution = 'id' AND metric = 'bleu' AND delta IS NOT NULL
    ORDER BY delta DESC, model_id LIMIT 5""", "comparison"))
def q_leaderboard(spark, d):
    return compare.leaderboard(evaluation(spark, d).comparison)


@register("prediction_counts", sql("SELECT model_id, distribution, variant, count(*) AS n FROM preds GROUP BY ALL",
                                   "preds"))
def q_prediction_counts(spark, d):
    return (ev.predictions(examples(spark, d)).groupBy("model_id", "distribution", "variant")
            .agg(F.count(F.lit(1)).alias("n")))
