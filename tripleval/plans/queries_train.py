"""Registered queries: training-example encoding and generation batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode
from ..operators.generate import validation_inputs
from ..operators.triplets import parse_prompt
from .oracle import sql
from .registry import examples, register

MAX_LEN = encode.MAX_LEN
BATCH = 8


def _train(ex):
    return ex.where(F.col("split") == "train").select("example_id", "prompt", "response")


def _val(ex):
    return ex.where(F.col("split").isin("id_val", "od_val")).select("dataset", "example_id", "prompt", "response")


def _encoded(spark, d):
    train = _train(examples(spark, d))
    return encode.encode_examples(train, encode.build_vocab(train))


@register("build_vocab", sql("SELECT * FROM vocab", "vocab"))
def q_build_vocab(spark, d):
    return encode.build_vocab(_train(examples(spark, d)))


@register("encode_examples", sql("SELECT * FROM enc", "enc"))
def q_encode_examples(spark, d):
    return _encoded(spark, d)


@register("truncate_left", sql("SELECT example_id, input_ids FROM masked", "masked"))
def q_truncate_left(spark, d):
    enc = _encoded(spark, d)
    return enc.select("example_id",
                      encode.truncate_left(F.concat("prompt_ids", "answer_ids"), MAX_LEN).alias("input_ids"))


@register("mask_labels", sql("SELECT example_id, input_ids, kept_prompt, labels, attention_mask FROM masked",
                             "masked"))
def q_mask_labels(spark, d):
    return encode.mask_labels(_encoded(spark, d), MAX_LEN).select(
        "example_id", "input_ids", "kept_prompt", "labels", "attention_mask")


@register("pad_batches", sql(f"""SELECT example_id, batch_id, pos_in_batch,
    list_concat(input_ids, list_transform(range(mx - len(input_ids)), lambda x: 0)) AS input_ids,
    list_concat(attention_mask, list_transform(range(mx - len(input_ids)), lambda x: 0)) AS attention_mask,
    list_concat(labels, list_transform(range(mx - len(input_ids)), lambda x: -100)) AS labels
    FROM (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS mx FROM
      (SELECT *, CAST((rn - 1) // {BATCH} AS BIGINT) AS batch_id, CAST((rn - 1) % {BATCH} AS INTEGER) AS pos_in_batch
       FROM (SELECT *, row_number() OVER (ORDER BY example_id) AS rn FROM masked)))""", "masked"))
def q_pad_batches(spark, d):
    return encode.pad_batches(encode.mask_labels(_encoded(spark, d), MAX_LEN), BATCH)


@register("truncate_inference_prompt", sql(f"""SELECT dataset, example_id,
    CASE WHEN len(prompt_ids) > {MAX_LEN} THEN list_slice(prompt_ids, len(prompt_ids) - {MAX_LEN - 1}, len(prompt_ids))
         ELSE prompt_ids END AS ids_tail,
    CASE WHEN len(prompt_ids) > {MAX_LEN} THEN list_slice(prompt_ids, 1, {MAX_LEN}) ELSE prompt_ids END AS ids_head
    FROM enc_val""", "enc_val"))
def q_truncate_inference_prompt(spark, d):
    ex = examples(spark, d)
    enc = encode.encode_examples(_val(ex), encode.build_vocab(_train(ex)), keys=("dataset", "example_id"))
    return enc.select("dataset", "example_id",
                      encode.truncate_inference_prompt(F.col("prompt_ids"), MAX_LEN, "tail").alias("ids_tail"),
                      encode.truncate_inference_prompt(F.col("prompt_ids"), MAX_LEN, "head").alias("ids_head"))


@register("batch_prompts", sql("""SELECT distribution, example_id,
    CAST((row_number() OVER (ORDER BY distribution, example_id) - 1) // 4 AS BIGINT) AS batch_id FROM inputs""",
                               "inputs"))
def q_batch_prompts(spark, d):
    inputs = validation_inputs(parse_prompt(examples(spark, d))).select("distribution", "example_id")
    return encode.batch_prompts(inputs, ["distribution", "example_id"], 4)
