"""Join helpers: broadcast behind a check of the side's bytes, skew-split join beyond it.

Hot keys are the norm in token joins (a stop-word sits on every row) and can
appear in lookups (one training row may be the best match for many rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table

# Bytes of a table in memory below which a side is broadcast after measuring it.
BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 48


def measured(df: DataFrame) -> tuple[int, int, int]:
    """(rows, bytes, bytes of the largest row) of ``df``: texts by their length, other columns by 8."""
    size = F.lit(ROW_OVERHEAD + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"),
               F.coalesce(F.max(size), F.lit(1)).alias("m")).first()
    return r["n"], r["b"], r["m"]


def skew_split_join(big: DataFrame, small: DataFrame, keys: Sequence[str], small_rows_per_key: int,
                    how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Equi-join that isolates heavy keys with a proven bound instead of replicating ``small``.

    With n rows on ``big`` and at most k = ``small_rows_per_key`` rows per key
    on ``small``, take ``T = ceil(n * k / limit)``.  At most ``limit / k`` key
    values can hold more than T rows of ``big`` (their counts would exceed n
    otherwise), so the heavy-key list and the heavy keys' slice of ``small``
    (at most ``limit`` rows) are both broadcast, and heavy keys join map-side.
    Every other key joins by a shuffle in which no key has more than T rows on
    ``big``.  ``big`` is written once, as it is read several times.  ``how`` is
    ``inner`` or ``left`` (``big`` kept).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    keys = list(keys)
    big = write_table(big, "skew-big")
    n = big.count()
    threshold = max(1, math.ceil(n * max(1, small_rows_per_key) / max(1, limit)))
    heavy = F.broadcast(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                        .where(F.col("_n") > threshold).select(*keys))
    big_hot = big.join(heavy, keys, "left_semi")
    big_cool = big.join(heavy, keys, "left_anti")
    small_hot = small.join(heavy, keys, "left_semi")
    hot = big_hot.join(F.broadcast(small_hot), keys, how)
    cool = big_cool.join(small, keys, how)
    return hot.unionByName(cool)


def frequent_rows(small: DataFrame, count: str, rows: int) -> int:
    """The least power of two such that at most ``rows`` rows of ``small`` have a larger ``count``."""
    classes = small.where(F.col(count) > 0).groupBy(F.floor(F.log2(count)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 64, 0
    for c, n in sorted(classes, reverse=True):      # one row per doubling of a long
        held += n
        if held > rows:
            break
        least = c
    return 1 << least


def parted_by_count(small: DataFrame, count: str, limit: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``small`` expected most often, as many as ``limit`` bytes hold; the others), without ``count``."""
    least = frequent_rows(small, count, limit // largest)
    often = F.col(count) >= F.lit(least) if least < 1 << 63 else F.lit(False)
    return small.where(often).drop(count), small.where(~F.coalesce(often, F.lit(False))).drop(count)


def checked_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                 small_rows_per_key: int = 1, limit: int | None = None, count: str | None = None) -> DataFrame:
    """Broadcast ``small`` when its measured bytes stay below ``limit`` (``BROADCAST_BYTES``);
    otherwise a skew-split join, for ``small`` has at most ``small_rows_per_key`` rows per key.

    ``count`` names a column of ``small``, which is left out of the result, that tells how often a key is expected
    in ``big``.  The rows of ``small`` expected most often, as many as the limit holds, are then broadcast, and only
    the rows of ``big`` without any of them are written and shuffled; ``big`` is read twice for it.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    keys = list(keys)
    _, size, largest = measured(small)
    plain = small if count is None else small.drop(count)
    if size <= limit:
        return big.join(F.broadcast(plain), keys, how)
    if count is None:
        return skew_split_join(big, plain, keys, small_rows_per_key, how, limit // largest)
    hot, cool = parted_by_count(small, count, limit, largest)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(skew_split_join(rest, cool, keys, small_rows_per_key, how, limit // largest))


def runs_of(rows: DataFrame, keys: Sequence[str], value: str, row: str, place: str | None = None) -> DataFrame:
    """(keys..., place, ``value`` as an array): neighbours of one ``row`` (a long) as one array, so that an exploded row
    whose pieces are still together is few arrays, and nothing is sorted for it.  With ``place``, an array holds the
    values of consecutive places, and comes with the first of them."""
    keys = list(keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(n).to_numpy()
            if not len(at):
                continue
            new = at[1:] != at[:-1]
            if place:
                where = batch.column(n + 2).to_numpy()
                new |= where[1:] != where[:-1] + 1
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), batch.column(n + 1))
            heads = batch.select([*range(n), *([n + 2] if place else [])]).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*heads.columns, lists], names=[*heads.schema.names, value])

    named = [place] if place else []
    cols = rows.select(*keys, row, value, *named)
    schema = T.StructType([*[cols.schema[k] for k in [*keys, *named]], T.StructField(value, T.ArrayType(cols.schema[value].dataType))])
    return cols.mapInArrow(run, schema)


def gathered(rows: DataFrame, keys: Sequence[str], value: str, row: str) -> DataFrame:
    """(keys..., ``value`` as an array in no given order): one row per distinct keys, with its non-null values.
    Neighbours of one ``row`` are put into one array before the shuffle (``runs_of``)."""
    return runs_of(rows, keys, value, row).groupBy(*keys).agg(F.array_compact(F.flatten(F.collect_list(value))).alias(value))
