"""Spectral statistics of weight matrices (per layer, then per model).

Plan shape: tall-skinny QR by a reduction tree.  Each task folds its rows of a layer, a block at a
time, into an upper triangle R of at most d x d numbers (numpy inside ``mapInPandas``, at most
``MAX_OPEN_LAYERS`` open at once).  Triangles of a layer are stacked and folded again in groups of about
``FAN_IN``, round by round, until one group holds those left of a layer.  The singular values of the last
R are those of the layer; the condition number is never squared, as in W'W.  A task holds FAN_IN
triangles at most, and only triangles travel, each as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

LAYER = ["model_id", "variant", "layer"]
SPECTRAL_METRICS = ["log_norm", "log_spectral_norm", "stable_rank", "alpha", "alpha_weighted", "log_alpha_norm"]
EIG_REL_TOL = 1e-10


def frobenius_norm(weights: DataFrame) -> DataFrame:
    """sqrt of the sum of squared entries per layer (native aggregate)."""
    sq = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x * x)
    return weights.groupBy(*LAYER).agg(F.round(F.sqrt(F.sum(sq)), 6).alias("frobenius_norm"))


# Layers a task keeps open before it emits the oldest: emitting early only adds rows to fold.
MAX_OPEN_LAYERS = 16
# Triangles folded at once; rows of weights folded at once, as a multiple of their length.
FAN_IN = 8
BLOCK_ROWS = 2

TRIANGLE = "model_id string, variant string, layer string, d int, triangle binary"


def fold(blocks: list[np.ndarray]) -> np.ndarray:
    """The R of the QR decomposition of stacked rows."""
    x = np.vstack(blocks)
    return np.linalg.qr(x, mode="r") if len(x) > 1 else x


class _Layer:
    """Rows of one layer, folded whenever a block is full."""

    def __init__(self) -> None:
        self.blocks: list[np.ndarray] = []
        self.rows = 0

    def add(self, rows: np.ndarray) -> None:
        for k in range(0, len(rows), max(1, BLOCK_ROWS * rows.shape[1])):
            self.blocks.append(rows[k:k + max(1, BLOCK_ROWS * rows.shape[1])])
            self.rows += len(self.blocks[-1])
            if self.rows > 2 * BLOCK_ROWS * rows.shape[1]:
                self.blocks = [fold(self.blocks)]
                self.rows = len(self.blocks[0])

    def row(self, key: tuple) -> pd.DataFrame:
        r = np.ascontiguousarray(fold(self.blocks), np.float64)
        return pd.DataFrame([(*key, r.shape[1], r.tobytes())], columns=[*LAYER, "d", "triangle"])


def _triangles(batches: Iterator[pd.DataFrame], max_open: int = MAX_OPEN_LAYERS) -> Iterator[pd.DataFrame]:
    layers: dict[tuple, _Layer] = {}
    for b in batches:
        for key, g in b.groupby(LAYER, sort=False, dropna=False):
            if key not in layers:
                if len(layers) >= max_open:
                    oldest = next(iter(layers))
                    yield layers.pop(oldest).row(oldest)
                layers[key] = _Layer()
            layers[key].add(np.vstack(g["values"].to_numpy()))
    for key, layer in layers.items():
        yield layer.row(key)


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    d = int(rows["d"].iloc[0])
    return fold([np.frombuffer(t, np.float64).reshape(-1, d) for t in rows["triangle"]])


def _fold_group(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[:1].assign(triangle=[np.ascontiguousarray(_stacked(rows)).tobytes()])


def triangles(weights: DataFrame, fan_in: int = FAN_IN, max_open_layers: int = MAX_OPEN_LAYERS) -> DataFrame:
    """(model_id, variant, layer, d, triangle): at most ``fan_in`` triangles of each layer, about."""
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _triangles(batches, max_open_layers)

    found = write_table(weights.select(*LAYER, "values").mapInPandas(first, TRIANGLE), "triangles")
    while (most := found.groupBy(*LAYER).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 2 * fan_in:
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // fan_in)))
        folded = found.withColumn("deal", deal).groupBy(*LAYER, "deal").applyInPandas(
            lambda rows: _fold_group(rows.drop(columns="deal")), TRIANGLE)
        found = write_table(folded, "triangles")
    return found


def power_law_alpha(ev: np.ndarray) -> float | None:
    """Power-law exponent by maximum likelihood, xmin chosen by minimum KS distance (Clauset et al. 2009)."""
    ev = np.sort(ev)
    best = None
    for i in range(len(ev) - 1):
        if i > 0 and ev[i] == ev[i - 1]:
            continue
        xmin = ev[i]
        tail = ev[i:]
        m = len(tail)
        s = np.log(tail / xmin).sum()
        if s <= 0:
            continue
        a = 1.0 + m / s
        fit = 1.0 - (tail / xmin) ** (1.0 - a)
        hi = np.arange(1, m + 1) / m
        lo = np.arange(0, m) / m
        dist = max(np.abs(hi - fit).max(), np.abs(lo - fit).max())
        if best is None or dist < best[0]:
            best = (dist, a)
    return None if best is None else float(best[1])


def layer_metrics(eigs: np.ndarray) -> dict[str, float | None]:
    lam = np.clip(eigs, 0.0, None)
    top = lam.max() if lam.size else 0.0
    pos = lam[lam > top * EIG_REL_TOL] if top > 0 else lam[:0]
    if pos.size == 0:
        return {k: None for k in SPECTRAL_METRICS}
    total, top = float(pos.sum()), float(pos.max())
    alpha = power_law_alpha(pos)
    out = {"log_norm": np.log10(total), "log_spectral_norm": np.log10(top), "stable_rank": total / top,
           "alpha": alpha,
           "alpha_weighted": None if alpha is None else alpha * np.log10(top),
           "log_alpha_norm": None if alpha is None else float(np.log10(np.sum(pos ** alpha)))}
    return {k: (None if v is None else float(v)) for k, v in out.items()}


def _singular_stats(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    values = np.linalg.svd(_stacked(rows), compute_uv=False)
    stats = layer_metrics(values * values)
    return pd.DataFrame([(*key, k, v) for k, v in stats.items() if v is not None], columns=[*LAYER, "metric", "value"])


def spectral_layer_stats(weights: DataFrame) -> DataFrame:
    """(model_id, variant, layer, metric, value); a metric that cannot be fitted is absent."""
    return (triangles(weights).groupBy(*LAYER).applyInPandas(
        _singular_stats, "model_id string, variant string, layer string, metric string, value double")
        .withColumn("value", F.round("value", 6)))


def spectral_summary(layer_stats: DataFrame) -> DataFrame:
    """Mean of each layer metric per (model, variant)."""
    return (layer_stats.groupBy("model_id", "variant", "metric")
            .agg(F.round(F.avg("value"), 6).alias("value")))


def filter_has_spectra(runs: DataFrame, changes: DataFrame, metric: str = "alpha_weighted") -> DataFrame:
    """Successful ``runs`` of models with a spectral change of ``metric`` (``changes`` from ``compare_spectra``), with its
    delta; a model without one, or with a null delta, is left out."""
    delta = changes.where((F.col("metric") == metric) & F.col("delta").isNotNull()) \
        .select("model_id", F.col("delta").alias(f"{metric}_delta"))
    return runs.where(F.col("status") == "success").join(delta, "model_id")
