import re

import pytest
from pyspark.sql import functions as F

from tripleval.functions import text

WS_SAMPLES = [" a ", "\t\n a b \r\n", " x ", "\x0b\x0cy\x1c\x1f", "　z ", "", "   ", "no-ws"]


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in WS_SAMPLES], "s string")
    got = [r[0] for r in df.select(text.py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in WS_SAMPLES]


def test_words_match_python_split(spark):
    samples = ["a  b\tc\nd", "  lead ing", "x y", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [list(r[0]) for r in df.select(text.words(F.col("s"))).collect()]
    assert got == [s.split() for s in samples]


def test_rouge_tokens(spark):
    df = spark.createDataFrame([("The Cat's 9 lives, é-x!",)], "s string")
    assert df.select(text.rouge_tokens(F.col("s"))).first()[0] == ["the", "cat", "s", "9", "lives", "x"]


def _py_13a(line: str) -> list[str]:
    """Independent Python form of the 13a tokeniser (mteval-v13a)."""
    line = line.replace("-\n", "").replace("\n", " ")
    for ent, ch in [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        line = line.replace(ent, ch)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


BLEU_SAMPLES = ["Hello, world.", "It costs $3.50 (approx.)", "well-known 1-2 &amp; a&lt;b", "end-\nline x/y",
                "don't stop", "3,000.5 items; done?", ""]


@pytest.mark.parametrize("s", BLEU_SAMPLES)
def test_bleu_tokens_match_13a(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert list(df.select(text.bleu_tokens(F.col("s"))).first()[0]) == _py_13a(s)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [list(r[0]) for r in df.select(text.ngrams(F.col("t"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]


def test_non_blank_lines(spark):
    df = spark.createDataFrame([("a\n \n\tb\n\nc\n",)], "s string")
    assert list(df.select(text.non_blank_lines(F.col("s"))).first()[0]) == ["a", "\tb", "c"]
