"""Triplet transforms: fact rows -> triplets, triplets -> prompts, prompts -> parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import (parse_observations, parse_ok, parse_question,
                                 render_inference_prompt)
from ..functions.text import py_strip
from ..sources.fixtures import FACT_COLS

# Fixed value: question asked of a fact row.
FACT_QUESTION = "Can you infer a general rule from the observations of type {type} and template {template}?"


def facts_to_triplets(facts: DataFrame, sep: str = "", null_text: str = "nan",
                      id_col: str = "fact_id", dataset: str = "od") -> DataFrame:
    """Six facts concatenated in fixed order (missing -> ``null_text``), rule as answer."""
    def txt(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text))

    obs = F.concat_ws(sep, *[txt(c) for c in FACT_COLS])
    head, rest = FACT_QUESTION.split("{type}")
    mid, tail = rest.split("{template}")
    question = F.concat(F.lit(head), txt("rule type"), F.lit(mid), txt("rule template"), F.lit(tail))
    return facts.select(F.col(id_col).alias("triplet_id"), F.lit(dataset).alias("dataset"),
                        F.lit(None).cast("string").alias("form"), obs.alias("observations"),
                        question.alias("question"), F.col("rule").alias("answer"))


def sql_facts_to_triplets(source: str, sep: str = "", null_text: str = "nan", dataset: str = "od") -> str:
    parts = f" || '{sep}' || ".join(f"coalesce(\"{c}\", '{null_text}')" for c in FACT_COLS)
    return f"""SELECT fact_id AS triplet_id, '{dataset}' AS dataset, CAST(NULL AS VARCHAR) AS form,
       {parts} AS observations,
       'Can you infer a general rule from the observations of type ' || coalesce("rule type", '{null_text}') ||
       ' and template ' || coalesce("rule template", '{null_text}') || '?' AS question,
       rule AS answer FROM ({source})"""


def render_prompt(triplets: DataFrame) -> DataFrame:
    """Triplet -> example: prompt template, stripped answer as response, text = prompt + response."""
    prompt = render_inference_prompt(F.col("observations"), F.col("question"))
    resp = py_strip(F.col("answer"))
    keep = [c for c in triplets.columns if c not in ("observations", "question", "answer", "triplet_id")]
    return (triplets.select(F.col("triplet_id").alias("example_id"), *keep,
                            prompt.alias("prompt"), resp.alias("response"))
            .withColumn("text", F.concat("prompt", "response")))


def parse_prompt(examples: DataFrame) -> DataFrame:
    """Inverse of the template; ``parse_ok`` is false when the question marker is absent."""
    keep = [c for c in examples.columns if c not in ("prompt", "response", "text")]
    return examples.select(*keep, "prompt",
                           parse_observations(F.col("prompt")).alias("observations"),
                           parse_question(F.col("prompt")).alias("question"),
                           py_strip(F.col("response")).alias("reference"),
                           parse_ok(F.col("prompt")).alias("parse_ok"))
