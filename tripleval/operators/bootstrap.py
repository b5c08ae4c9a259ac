"""Poisson bootstrap of per-example scores (Chamandy et al. 2012).

Each (example, replicate) weight is Poisson(1), drawn by inverting the CDF at
a uniform number: the first 52 bits of ``md5('seed|replicate|key')``.  The
weights are therefore reproducible under task retries and independent of
partitioning, and the same example carries the same weight in every model and
variant (a paired bootstrap).  An Arrow batch draws the weights of its examples
as one matrix (examples x replicates) and multiplies it with the scores; a task
emits one row of partial sums per group and replicate, so that no example is
copied per replicate and only those rows are shuffled.  The exact percentiles
then run over ``replicates`` values per group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POISSON_MAX_K = 16
_U_BITS = 52
# Groups whose sums a task keeps before it emits them.
OPEN_GROUPS = 1024


def poisson_cdf() -> list[float]:
    """P(K <= k) for k = 0 .. POISSON_MAX_K - 1 of Poisson(1)."""
    out, acc = [], 0.0
    for k in range(POISSON_MAX_K):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def weight_matrix(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of each key (rows) in each replicate; ``keys`` hold the separator in front."""
    starts = [f"{seed}|{r}".encode() for r in range(replicates)]
    drawn = b"".join(hashlib.md5(s + k).digest() for k in (x.encode() for x in keys) for s in starts)
    top = np.frombuffer(drawn, ">u8").reshape(len(keys), replicates, 2)[:, :, 0]
    u = (top >> np.uint64(64 - _U_BITS)).astype(np.float64) / float(1 << _U_BITS)
    return np.searchsorted(np.array(poisson_cdf()), u, side="right").astype(np.float64)


def sql_poisson_weight(u: str) -> str:
    cdf = poisson_cdf()
    whens = " ".join(f"WHEN {u} < CAST('{c!r}' AS DOUBLE) THEN {k}" for k, c in enumerate(cdf))
    return f"(CASE {whens} ELSE {POISSON_MAX_K} END)"


def sql_uniform_from_md5(parts: list[str]) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, {_U_BITS // 4})) AS BIGINT) / {float(1 << _U_BITS)})"


def rouge_bootstrap(scores: DataFrame, key_cols, metrics, group=("model_id", "variant", "distribution"),
                    replicates: int = 200, seed: int = 42) -> DataFrame:
    """(group..., metric, low, mid, high, mean): 2.5 / 50 / 97.5 percentiles of replicate means."""
    group, key_cols, metrics = list(group), list(key_cols), list(metrics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        numbers: dict[tuple, int] = {}

        def emit() -> pa.RecordBatch:
            # replicate -1 has weight 1: its mean is the plain mean
            reps = np.tile(np.arange(-1, replicates, dtype=np.int32), len(numbers))
            total = np.concatenate([sums[k] for k in numbers.values()])
            cols = [pa.array([g[c] for g in numbers for _ in range(replicates + 1)], pa.string()) for c in range(len(group))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(reps), *(pa.array(total[:, c]) for c in range(total.shape[1]))],
                                              names=[*group, "rep", "ws", *metrics])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            w = weight_matrix(coded.dictionary.to_pylist(), replicates, seed)
            w = np.column_stack([np.ones(len(w)), w])
            own = coded.indices.to_numpy()
            scores_ = np.column_stack([np.ones(len(own)), *(np.nan_to_num(batch.column(1 + len(group) + k).to_numpy(zero_copy_only=False))
                                                            for k in range(len(metrics)))])
            place: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*(batch.column(1 + k).to_pylist() for k in range(len(group))))):
                place.setdefault(g, []).append(i)
            for g, at in place.items():
                k = numbers.setdefault(g, len(numbers))
                part = w[own[at]].T @ scores_[at]
                sums[k] = sums[k] + part if k in sums else part
            if len(numbers) >= OPEN_GROUPS:
                yield emit()
                sums.clear()
                numbers.clear()
        if numbers:
            yield emit()

    key = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in key_cols])
    rows = scores.select(key.alias("_key"), *[F.col(c).cast("string").alias(c) for c in group], *[F.col(m).cast("double").alias(m) for m in metrics])
    schema = ", ".join([*(f"{c} string" for c in group), "rep int", "ws double", *(f"{m} double" for m in metrics)])
    per_rep = rows.mapInArrow(run, schema).groupBy(*group, "rep") \
        .agg(F.sum("ws").alias("ws"), *[F.sum(m).alias(m) for m in metrics]).where(F.col("ws") > 0)
    per_rep_long = per_rep.select(*group, "rep", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(m) / F.col("ws")).alias("m")) for m in metrics])).alias("s")) \
        .select(*group, "rep", "s.metric", "s.m")
    out = per_rep_long.groupBy(*group, "metric").agg(
        F.percentile(F.when(F.col("rep") >= 0, F.col("m")), [0.025, 0.5, 0.975]).alias("p"),
        F.max(F.when(F.col("rep") < 0, F.col("m"))).alias("mean"))
    return out.select(*group, "metric", F.round(F.col("p")[0], 6).alias("low"),
                      F.round(F.col("p")[1], 6).alias("mid"), F.round(F.col("p")[2], 6).alias("high"),
                      F.round("mean", 6).alias("mean"))
