"""Answer generation: native generators and a pluggable Arrow-batch generator.  The
answerer that stands in for fine-tuning is in ``retrieve``.

Generation output follows a causal LM: ``full_text`` = prompt + continuation,
and ``extract_answer`` recovers the answer from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import extract_answer, render_inference_prompt
from ..functions.text import cap_words

# New-token limit of generation, and the native generators.
MAX_NEW_WORDS = 64
NATIVE_GENERATORS = ("lead", "last_line", "echo")
END_MARK = "<|end|>"
# Bytes of text of the batches that a pluggable model gets: more rows than this come in steps.
BATCH_BYTES = 8 << 20

KEY = ["distribution", "example_id"]
TEXT_COLS = ["observations", "question", "reference"]


def native_continuation(name: str, obs: F.Column, q: F.Column, max_new_words: int = MAX_NEW_WORDS) -> F.Column:
    if name == "lead":          # first line of the observations
        return cap_words(F.split_part(obs, F.lit("\n"), F.lit(1)), max_new_words)
    if name == "last_line":     # last line of the observations
        return cap_words(F.split_part(obs, F.lit("\n"), F.lit(-1)), max_new_words)
    if name == "echo":          # the question itself
        return cap_words(q, max_new_words)
    raise ValueError(f"unknown native generator {name!r}")


def validation_inputs(parsed: DataFrame) -> DataFrame:
    """Parsed validation examples -> generation inputs keyed by (distribution, example_id)."""
    return (parsed.where(F.col("split").isin("id_val", "od_val"))
            .select(F.when(F.col("split") == "id_val", "id").otherwise("od").alias("distribution"),
                    "example_id", "observations", "question", "reference"))


def cross_models_examples(inputs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every model on every example: the model list is a generated column, not a join."""
    return inputs.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))


def _with_continuations(inputs: DataFrame, models: Sequence[str], max_new_words: int) -> DataFrame:
    """The prompt and each model's continuation, once per example: the rows are fanned out after it."""
    obs, q = F.col("observations"), F.col("question")
    return inputs.select("*", render_inference_prompt(obs, q).alias("prompt"),
                         *[native_continuation(m, obs, q, max_new_words).alias(f"_said_{k}") for k, m in enumerate(models)])


def _of_model(models: Sequence[str]) -> F.Column:
    """The continuation of the row's model."""
    return F.coalesce(*[F.when(F.col("model_id") == m, F.col(f"_said_{k}")) for k, m in enumerate(models)])


def generate_native(inputs: DataFrame, models: Sequence[str], max_new_words: int = MAX_NEW_WORDS) -> DataFrame:
    """``generations`` for native generators; one projection, no shuffle."""
    texts = _with_continuations(inputs, models, max_new_words)
    rows = cross_models_examples(texts, models)
    return rows.select("model_id", *KEY, *TEXT_COLS, "prompt",
                       F.concat("prompt", _of_model(models), F.lit("\n" + END_MARK)).alias("full_text"))


def generate_native_variants(inputs: DataFrame, models: Sequence[str], carry: Sequence[str] = (),
                             max_new_words: int = MAX_NEW_WORDS) -> DataFrame:
    """Baseline and trained generations of native generators in one pass.

    ``inputs`` carries ``answer``: the trained answerer's retrieved answer (null
    when no train row shares a token).  Each input row fans out to
    (model, variant) rows; the trained variant falls back to the baseline
    continuation, so no second pass or join over generated rows is needed.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(v).alias("variant"))
                      for m in models for v in ("baseline", "finetuned")])
    rows = _with_continuations(inputs, models, max_new_words).withColumn("_mv", F.explode(pairs)) \
        .select("*", "_mv.model_id", "_mv.variant").drop("_mv")
    base = F.concat(_of_model(models), F.lit("\n" + END_MARK))
    tuned = F.coalesce(F.concat(F.col("answer"), F.lit("\n" + END_MARK)), base)
    full = F.concat("prompt", F.when(F.col("variant") == "baseline", base).otherwise(tuned))
    return rows.select("model_id", "variant", *KEY, *TEXT_COLS, *carry, "prompt", full.alias("full_text"))


GeneratorFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``BATCH_BYTES`` of text each, or one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            sizes += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        held = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, held + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _with_texts(batches: Iterator[pa.RecordBatch], factory: GeneratorFactory, name: str) -> Iterator[pa.RecordBatch]:
    """The batches, in steps, with the model's texts as a further column."""
    fn = factory()
    for batch in batches:
        for part in _steps(batch):
            texts = pa.array(fn(part.to_pandas()).astype(str), pa.string(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, name])


def generate_with(inputs: DataFrame, model_id: str, factory: GeneratorFactory) -> DataFrame:
    """Pluggable model over Arrow batches.

    ``factory()`` runs once per task and returns ``fn(batch) -> full_text``
    where ``batch`` has columns prompt, observations, question.  Batches hold at
    most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows and ``BATCH_BYTES``.
    """
    prompt = render_inference_prompt(F.col("observations"), F.col("question"))
    src = inputs.select(*KEY, *TEXT_COLS, prompt.alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_texts(batches, factory, "full_text")

    rows = src.mapInArrow(run, "distribution string, example_id bigint, observations string, question string, reference string, "
                               "prompt string, full_text string")
    return rows.select(F.lit(model_id).alias("model_id"), "*")


def generate_with_variants(inputs: DataFrame, model_id: str, factory: GeneratorFactory) -> DataFrame:
    """Both variants of a pluggable model in one pass over the batches.  ``inputs`` carries ``answer``:
    the trained variant answers with it where there is one, else like the baseline."""
    prompt = render_inference_prompt(F.col("observations"), F.col("question"))
    src = inputs.select(*KEY, *TEXT_COLS, "answer", prompt.alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _with_texts(batches, factory, "baseline")

    rows = src.mapInArrow(run, "distribution string, example_id bigint, observations string, question string, reference string, "
                               "answer string, prompt string, baseline string")
    tuned = F.coalesce(F.concat("prompt", "answer", F.lit("\n" + END_MARK)), F.col("baseline"))
    both = F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("baseline").alias("full_text")),
                             F.struct(F.lit("finetuned").alias("variant"), tuned.alias("full_text"))))
    return rows.withColumn("_v", both).select(F.lit(model_id).alias("model_id"), "_v.variant", *KEY, *TEXT_COLS, "prompt",
                                              "_v.full_text")


def to_predictions(generations: DataFrame, variant: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """generations -> ``predictions`` (model, variant, distribution, example, texts, prediction).

    ``variant`` labels single-variant generations; None keeps their ``variant`` column."""
    v = F.lit(variant) if variant is not None else F.col("variant")
    return generations.select("model_id", v.alias("variant"), *KEY, *TEXT_COLS, *carry,
                              extract_answer(F.col("prompt"), F.col("full_text")).alias("prediction"))


def join_predictions_references(predictions: DataFrame, inputs: DataFrame, unmatched: str = "fail") -> DataFrame:
    """Align predictions with observations / questions / references by example key.

    Equi-join on (distribution, example_id); each input row matches one
    prediction per (model, variant), so the fan-out is bounded by the fleet.
    A prediction without an input, or an input without a prediction, fails the job;
    with ``unmatched="keep"`` such rows stay, with nulls for what is missing
    (``unmatched_counts`` counts them).
    """
    if unmatched not in ("fail", "keep"):
        raise ValueError("unmatched must be 'fail' or 'keep'")
    both = predictions.select("model_id", "variant", *KEY, "prediction", F.lit(True).alias("_predicted")) \
        .join(inputs.select(*KEY, *TEXT_COLS, F.lit(True).alias("_known")), KEY, "full")
    if unmatched == "fail":
        said = F.concat(F.lit("example "), F.coalesce(F.concat_ws("/", *KEY), F.lit("null")),
                        F.when(F.col("_known").isNull(), F.lit(" has a prediction and no input")).otherwise(F.lit(" has no prediction")))
        whole = F.col("_predicted").isNotNull() & F.col("_known").isNotNull()
        both = both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    return both.select("model_id", "variant", *KEY, *TEXT_COLS, "prediction")


def unmatched_counts(predictions: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: predictions without an input, and inputs without any prediction."""
    p, i = predictions.select(*KEY), inputs.select(*KEY)
    lost = p.join(i, KEY, "left_anti").select(F.lit(1).alias("p"), F.lit(0).alias("i")) \
        .unionAll(i.join(p, KEY, "left_anti").select(F.lit(0).alias("p"), F.lit(1).alias("i")))
    return lost.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("predictions_without_input"),
                    F.coalesce(F.sum("i"), F.lit(0)).alias("inputs_without_prediction"))
