"""Vectors of whole numbers for exact searches by inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import lookup_join

KEY = ["dim", "centre", "part"]
BLOCK_BYTES = 4 << 20
# Centres: vectors of the most frequent lengths, at most so many, and so many bytes, for each length.
CENTRE_LENGTHS = 64
CENTRES = 64
CENTRE_BYTES = 1 << 20

SCALE = 256
EXACT_FLOAT = 1 << 53
LONG = (1 << 63) - 1
# Scores travel as decimal(38, 0).
MOST = 10 ** 38 - 1


def whole_vectors(vectors: DataFrame, *extra: str, scale: int = SCALE) -> DataFrame:
    """vec_id, ``extra`` (as long), dim, vector (binary, float64: floor(scale * x) with x as double, a whole number of any
    size), norm (squared length) of the rows that take part: no null id, extra column or vector, and no null or non-finite
    component.  Components whose scaled value is beyond a double count as the largest double."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.dropna(subset=["vec_id", "embedding", *extra]).where(good)
    names = ["vec_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            offsets = lists.offsets.to_numpy()
            with np.errstate(over="ignore"):
                flat = np.nan_to_num(np.floor(lists.values.to_numpy() * float(scale)))
                ends = np.cumsum(np.append(0.0, flat * flat))
            raw = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            norms = ends[offsets[1:]] - ends[offsets[:-1]]
            if not np.isfinite(ends[-1]) or (len(flat) and np.abs(flat).max() > 1e7):   # sums of a batch would lose digits
                with np.errstate(over="ignore"):
                    norms = np.array([float((flat[a:b] ** 2).sum()) for a, b in zip(offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(np.diff(offsets).astype(np.int32)), pa.array(raw, pa.binary()),
                 pa.array(norms.astype(np.float64))], names=[*names, "dim", "vector", "norm"])

    cols = [F.col(c).cast("long").alias(c) for c in names]
    schema = ", ".join(f"{c} long" for c in names) + ", dim int, vector binary, norm double"
    return kept.select(*cols, x.alias("_x")).mapInArrow(run, schema)


def matrix(column: pd.Series | list, dim: int) -> np.ndarray:
    """The vectors of a column as rows."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), dim)


def score_type(x: np.ndarray, q: np.ndarray) -> type:
    """The cheapest type in which inner products of rows of ``x`` and ``q`` are exact."""
    largest = int(np.abs(x).max(initial=1)) * int(np.abs(q).max(initial=1)) * max(1, x.shape[-1])
    return np.float64 if largest < EXACT_FLOAT else np.int64 if largest < LONG else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return x.astype(kind, copy=False)
    out = np.empty(x.shape, object)
    out.flat = [int(v) for v in x.flat]
    return out


def as_long(score: Column) -> Column:
    """A decimal score as long; beyond 64 bits it stops at their limits."""
    return F.greatest(F.least(score, F.lit(LONG).cast("decimal(38, 0)")), F.lit(-LONG - 1).cast("decimal(38, 0)")).cast("long")


def centres(rows: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Up to CENTRES vectors of each of the most frequent lengths, about one for each block."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where((F.col("dim") > 0) & (F.col("n") > block)) \
        .orderBy(F.col("n").desc(), "dim").limit(CENTRE_LENGTHS)
    share = F.least(F.lit(CENTRES), F.ceil(F.col("n") / block), F.floor(F.lit(CENTRE_BYTES) / (8 * F.col("dim"))))
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vector"), "vector"))
    picked = rows.select("dim", "vector").join(F.broadcast(sizes.withColumn("share", share)), "dim").distinct() \
        .withColumn("order", order).where((F.col("order") <= CENTRES) & (F.col("order") <= F.col("share")))
    found: dict[int, list] = {}
    for r in picked.select("dim", "vector").collect():      # at most CENTRE_LENGTHS * CENTRE_BYTES
        found.setdefault(r["dim"], []).append(np.frombuffer(r["vector"], np.float64))
    return {d: np.stack(v) for d, v in found.items()}


def blocks(rows: DataFrame, block: int, *extra: str) -> DataFrame:
    """``rows`` with centre (the nearest one) and part: large neighbourhoods are dealt into parts of about
    ``block`` vectors and BLOCK_BYTES at most."""
    chosen = centres(rows, block)

    def run(batches):
        for frame in batches:
            frame = frame.assign(centre=np.int32(0))
            for dim, at in frame.groupby("dim").indices.items():
                if dim in chosen:
                    x, c = matrix(frame["vector"].iloc[at], int(dim)), chosen[dim]
                    near = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1).argmin(axis=1)
                    frame.loc[frame.index[at], "centre"] = near.astype(np.int32)
            yield frame

    more = "".join(f"{c} long, " for c in extra)
    rows = rows.mapInPandas(run, f"vec_id long, {more}dim int, vector binary, norm double, centre int")
    rows = write_table(rows, "vectors")
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * (F.col("dim") + 4)))))
    sizes = rows.groupBy("dim", "centre").agg(F.count(F.lit(1)).alias("m")).select("dim", "centre", F.ceil(F.col("m") / room).alias("parts"))
    rows = lookup_join(rows, sizes, ["dim", "centre"])
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", *extra, "vector"), F.col("parts")).cast("int")).drop("parts")
