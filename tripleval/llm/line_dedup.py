"""Removal of repeated three-line windows, with DataFrame functions only.

Every three consecutive lines of a document make a window.  Windows travel as two 64-bit hashes
with their document and position, never as text; a partial aggregation finds each window's
count and first occurrence.  A later occurrence covers its three lines, and the covered
positions of a document are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_mark")]


def windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """_id, _mark, _at, _a, _b: the windows of every document, hashed twice.  Windows of blank lines
    alone are left out.  The lines are hashed once; a window hashes the hashes of its lines."""
    parts = docs.select(*_row_key(F.col("doc_id"), F.col("text")), _lines(F.col("text")).alias("_lines")) \
        .where(F.size("_lines") >= size)
    hashed = parts.select("_id", "_mark", F.transform("_lines", lambda x: F.when(F.trim(x) == "", F.lit(None)).otherwise(
        F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))).alias("_h"))
    at = F.sequence(F.lit(0), F.size("_h") - size)
    one = hashed.select("_id", "_mark", "_h", F.explode(at).alias("_at"))
    window = F.slice("_h", F.col("_at") + 1, F.lit(size))
    return one.where(F.exists(window, lambda x: x.isNotNull())).select(
        "_id", "_mark", "_at", F.xxhash64(window).alias("_a"), F.xxhash64(F.lit(2), window).alias("_b"))


def covered_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """_id, _mark, _gone (sorted line numbers from 0): the lines that later occurrences cover."""
    found = write_table(windows(docs, size), "line-windows")
    place = F.struct("_id", "_mark", "_at")
    # an identical place is the same window of a repeated row, not a later occurrence
    repeated = found.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")) \
        .where("not (_first <=> _last)").select("_a", "_b", "_first")
    later = found.join(repeated, ["_a", "_b"]).where(~F.struct("_id", "_mark", "_at").eqNullSafe(F.col("_first")))
    lines = F.explode(F.sequence(F.col("_at"), F.col("_at") + (size - 1)))
    return later.select("_id", "_mark", lines.alias("_line")).groupBy("_id", "_mark") \
        .agg(F.sort_array(F.collect_set("_line")).alias("_gone"))


def drop_repeated_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``docs`` (with doc_id and text) where ``text`` has lost the lines of every ``size``-line window that also
    occurs earlier; adds n_lines and n_removed.

    Earlier: in a document of smaller doc_id (null first; equal ids by the hash of the text), or
    further up in the same document; occurrences may overlap.  Rows of equal id and text are one
    document and get the same result.  A document of fewer lines than ``size`` stays as it is,
    a null text stays null and has no lines.  Other columns pass through; n_lines and n_removed
    replace columns of these names.
    """
    gone = write_table(covered_lines(docs, size), "line-covered")
    rows = docs.select(F.struct("*").alias("_row"), *_row_key(F.col("doc_id"), F.col("text")))
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_mark").alias("_gone_mark"), "_gone")
    # texts and positions meet by shuffle at every size: the positions grow with the corpus
    joined = rows.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_mark") == F.col("_gone_mark")), "left")
    text = F.col("_row.text")
    lines = F.when(text.isNotNull(), _lines(text))
    # numbers of the lines that stay, then the lines
    left = F.get(F.transform(F.array(lines), lambda all_: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_gone")), lambda k: F.get(all_, k)), "\n")), F.lit(0))
    added = {"text": F.when(F.col("_gone").isNull(), text).otherwise(left),
             "n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}
    names = [*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns)]
    return joined.select(*[added[c].alias(c) if c in added else F.col(f"_row.`{c}`").alias(c) for c in names])
