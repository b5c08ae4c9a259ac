"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a table (keys, values and row overhead) up to which a side is broadcast.
BROADCAST_BYTES = 16 << 20
ROW_OVERHEAD = 64

# White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def small_bytes(df: DataFrame, *text_cols: str, array_cols: tuple[str, ...] = (), item: int = 8) -> int:
    """Bytes of ``df`` in memory: a fixed overhead per row, the texts, and the arrays at ``item`` bytes an element."""
    size = F.lit(ROW_OVERHEAD + 8 * len(df.columns)).cast("long")
    for c in text_cols:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    for c in array_cols:
        size = size + item * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                text_cols: tuple[str, ...] = (), limit: int = BROADCAST_BYTES, array_cols: tuple[str, ...] = (),
                item: int = 8) -> DataFrame:
    """Join ``big`` with a table of one row per key: broadcast when its measured bytes stay
    below ``limit``, otherwise an ordinary shuffle join (AQE splits skewed keys of ``big``)."""
    if small_bytes(small, *text_cols, array_cols=array_cols, item=item) <= limit:
        small = F.broadcast(small)
    return big.join(small, keys, how)


def words(text: Column) -> Column:
    """Words of a text as an array; other white space is turned into spaces first, so that the
    split needs no regular expression."""
    t = F.coalesce(text, F.lit(""))
    for ch in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
