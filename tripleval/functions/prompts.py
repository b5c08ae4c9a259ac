"""Prompt template, its inverse, and answer extraction as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip, sql_strip

# The prompt template markers.
OBS_MARK = "Training Observations:\n"
Q_MARK = "Question:\n"
A_MARK = "\n\nAnswer:\n"
ANSWER_WORD = "Answer:"


def render_inference_prompt(obs: Column, q: Column) -> Column:
    """Template with stripped observation and question, no answer."""
    return F.concat(F.lit(OBS_MARK), py_strip(obs), F.lit("\n\n" + Q_MARK), py_strip(q), F.lit(A_MARK))


def sql_render_inference_prompt(obs: str, q: str) -> str:
    return (f"('Training Observations:' || chr(10) || {sql_strip(obs)} || chr(10) || chr(10) || "
            f"'Question:' || chr(10) || {sql_strip(q)} || chr(10) || chr(10) || 'Answer:' || chr(10))")


def parse_observations(prompt: Column) -> Column:
    """Part before the first question marker, every observation marker removed."""
    return py_strip(F.replace(F.split_part(prompt, F.lit(Q_MARK), F.lit(1)), F.lit(OBS_MARK), F.lit("")))


def parse_question(prompt: Column) -> Column:
    """Part between the 1st and 2nd question marker, cut at the answer marker."""
    return py_strip(F.split_part(F.split_part(prompt, F.lit(Q_MARK), F.lit(2)), F.lit(A_MARK), F.lit(1)))


def parse_ok(prompt: Column) -> Column:
    return F.contains(prompt, F.lit(Q_MARK))


def sql_parse_observations(p: str) -> str:
    return sql_strip(f"replace(split_part({p}, 'Question:' || chr(10), 1), 'Training Observations:' || chr(10), '')")


def sql_parse_question(p: str) -> str:
    return sql_strip(
        f"split_part(split_part({p}, 'Question:' || chr(10), 2), chr(10) || chr(10) || 'Answer:' || chr(10), 1)")


def extract_answer(prompt: Column, full_text: Column) -> Column:
    """Generated text -> answer.

    Remainder after the prompt when the text starts with it; else the text
    after the last ``Answer:``; else the whole text.  Then the first line,
    stripped.
    """
    rest = F.when(F.startswith(full_text, prompt),
                  F.substring(full_text, F.length(prompt) + 1, 2147483647)) \
        .when(F.contains(full_text, F.lit(ANSWER_WORD)),
              F.split_part(full_text, F.lit(ANSWER_WORD), F.lit(-1))) \
        .otherwise(full_text)
    return py_strip(F.split_part(py_strip(rest), F.lit("\n"), F.lit(1)))


def sql_extract_answer(prompt: str, full: str) -> str:
    rest = (f"CASE WHEN starts_with({full}, {prompt}) THEN substr({full}, length({prompt}) + 1) "
            f"WHEN contains({full}, 'Answer:') THEN split_part({full}, 'Answer:', -1) ELSE {full} END")
    return sql_strip(f"split_part({sql_strip(rest)}, chr(10), 1)")
