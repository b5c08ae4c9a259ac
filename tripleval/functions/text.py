"""Text column functions.  All are JVM-side expressions (no Python UDF).

Each pattern has a DuckDB twin in ``SQL_*`` so the oracle SQL uses the
identical rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` / ``str.split()`` treat as whitespace,
# by the rule ``str.isspace`` (29 code points, the highest is U+3000).
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS_CHARS) + "]"
SQL_WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"

# ROUGE default tokens are maximal runs of [a-z0-9] after
# lower-casing (no stemming).
ROUGE_TOKEN = "[a-z0-9]+"

# The 13a (mteval-v13a) tokenisation steps, in order.
# 1. space around ASCII punctuation/symbols except ' , - .
# 2. split period/comma unless preceded by a digit
# 3. split period/comma unless followed by a digit
# 4. split dash preceded by a digit
BLEU13A_STEPS = [
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 ", r" \1 "),
    (r"([^0-9])([\.,])", "$1 $2 ", r"\1 \2 "),
    (r"([\.,])([^0-9])", " $1 $2", r" \1 \2"),
    (r"([0-9])(-)", "$1 $2 ", r"\1 \2 "),
]
# The HTML entities 13a unescapes, in order.
BLEU13A_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (character-set trim, no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {SQL_WS_CHARS})"


def non_blank_lines(c: Column) -> Column:
    """Lines of a text (split at ``\\n``) that are not blank after strip."""
    return F.filter(F.split(c, "\n"), lambda line: py_strip(line) != F.lit(""))


def sql_non_blank_lines(expr: str) -> str:
    return f"list_filter(string_split({expr}, chr(10)), lambda l: {sql_strip('l')} <> '')"


def words(c: Column) -> Column:
    """``str.split()``: whitespace-separated words, no empties."""
    return F.filter(F.split(py_strip(c), WS_CLASS + "+"), lambda w: w != F.lit(""))


def sql_words(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array({sql_strip(expr)}, '{WS_CLASS}+'), "
            f"lambda w: w <> '')")


def cap_words(c: Column, n: int) -> Column:
    """First ``n`` words joined by one space."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def sql_cap_words(expr: str, n: int) -> str:
    return f"array_to_string(list_slice({sql_words(expr)}, 1, {n}), ' ')"


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_TOKEN), 0)


def sql_rouge_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{ROUGE_TOKEN}')"


def bleu_normalise(c: Column) -> Column:
    """13a pre-processing and tokenisation up to the final whitespace split."""
    out = F.replace(c, F.lit("-\n"), F.lit(""))
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for ent, ch in BLEU13A_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, java_rep, _ in BLEU13A_STEPS:
        out = F.regexp_replace(out, pattern, java_rep)
    return out


def bleu_tokens(c: Column) -> Column:
    return words(bleu_normalise(c))


def sql_bleu_tokens(expr: str) -> str:
    out = f"replace({expr}, '-' || chr(10), '')"
    out = f"replace({out}, chr(10), ' ')"
    for ent, ch in BLEU13A_ENTITIES:
        out = f"replace({out}, '{ent}', '{ch}')"
    out = f"(' ' || {out} || ' ')"
    for pattern, _, re2_rep in BLEU13A_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{re2_rep}', 'g')"
    return sql_words(out)


def ngrams(tokens: Column, n: int) -> Column:
    """Array of space-joined n-grams (empty when fewer than n tokens)."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                    lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def sql_ngrams(tokens_expr: str, n: int) -> str:
    if n == 1:
        return tokens_expr
    return (f"CASE WHEN len({tokens_expr}) >= {n} THEN list_transform(range(1, len({tokens_expr}) - {n - 2}), "
            f"lambda i: array_to_string(list_slice({tokens_expr}, i, i + {n - 1}), ' ')) "
            f"ELSE []::VARCHAR[] END")
