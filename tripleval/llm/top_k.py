"""Exact top-k search by inner product with a pivot table.

The distances of all vectors to the same pivots are computed once.  Together they bound every distance
between two vectors: they fix the part of a vector in the pivots' span (its coordinates y) and the length
r of what is left, and d(q, x)^2 >= |y_q - y_x|^2 + (r_q - r_x)^2 is the largest lower bound that holds
for all vectors of these distances.  It caps the inner product by <y_q, y_x> + r_q r_x.  The pivots are
as far from each other as a sample has them, three for every four components.

1. Candidates are dealt into blocks around centres.  A block's table holds its vectors, their distances
   to the pivots, and the box of their coordinates.
2. Each query visits the block it lies in.  The k-th score found there is its threshold.
3. Other blocks are visited only where the box's cap reaches the threshold.
4. In a cell, candidates whose cap is below the threshold are out; the others are evaluated in the order
   of their caps, a fixed number at a time, until the k-th best score is above the next cap.

A cell is one block with a bounded number of queries, and gives at most k rows per query.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import lookup_join
from .vectors import KEY, MOST, as_long, as_type, blocks, matrix, score_type, whole_vectors

# Pivots: a share of the components, at most so many, from the most frequent lengths, of bounded bytes.
PIVOT_SHARE = 0.75
PIVOTS = 512
PIVOT_LENGTHS = 64
PIVOT_BYTES = 4 << 20
SAMPLED = 4
# Vectors of a block, queries of a cell, candidates evaluated between two looks at the next cap.
BLOCK = 4096
CELL_QUERIES = 4096
STEP = 16
QUERY_STEP = 256

TABLE = ("dim int, centre int, part int, low array<double>, high array<double>, ids binary, vectors binary, norms binary, distances binary")
FOUND = "query_id long, vec_id long, score decimal(38, 0), taken long"


def _wanted(dim: int) -> int:
    return max(1, min(PIVOTS, round(PIVOT_SHARE * dim), PIVOT_BYTES // (8 * SAMPLED * max(1, dim))))


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one farthest from the span of those before it."""
    left, rows = sample.copy(), []
    scale = np.sqrt((sample * sample).sum(axis=1).max(initial=0))
    for _ in range(min(most, *sample.shape)):
        size = np.sqrt((left * left).sum(axis=1))
        far = int(np.argmax(size))
        if not size[far] > 1e-6 * scale:
            break
        rows.append(far)
        axis = left[far] / size[far]
        left -= np.outer(left @ axis, axis)
    return sample[rows]


def choose_pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of the most frequent lengths; vectors of other lengths have none, and are all evaluated."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("dim > 0").orderBy(F.col("n").desc(), "dim").limit(PIVOT_LENGTHS)
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vector"), "vector"))
    share = F.least(F.lit(PIVOTS), F.round(PIVOT_SHARE * F.col("dim")), F.floor(F.lit(PIVOT_BYTES) / (8 * SAMPLED * F.col("dim"))))
    few = rows.select("dim", "vector").join(F.broadcast(sizes.select("dim")), "dim").distinct().withColumn("order", order) \
        .where((F.col("order") <= SAMPLED * PIVOTS) & (F.col("order") <= SAMPLED * F.greatest(F.lit(1), share)))
    found: dict[int, list] = {}
    for r in few.select("dim", "vector").collect():       # at most PIVOT_LENGTHS * PIVOT_BYTES
        found.setdefault(r["dim"], []).append(np.frombuffer(r["vector"], np.float64))
    with np.errstate(over="ignore", invalid="ignore"):
        return {d: spread(np.stack(v), _wanted(d)) for d, v in found.items() if np.abs(np.stack(v)).max() < 1e100}


def distances(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    own = (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(0, norm[:, None] + own - 2 * (x @ pivots.T)))


def coordinates(near: np.ndarray, norm: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What distances to the pivots and lengths fix of vectors: coordinates in the pivots' span, and the length of the rest."""
    if not len(pivots):
        return np.sqrt(norm)[:, None]
    own = (pivots * pivots).sum(axis=1)
    _, r = np.linalg.qr(pivots.T)
    y = (norm[:, None] + own - near * near) / 2 @ np.linalg.inv(r)
    return np.column_stack([y, np.sqrt(np.maximum(0, norm - (y * y).sum(axis=1)))])


def _slack(norm: np.ndarray, most: float) -> np.ndarray:
    """Rounding of caps is far below this."""
    return (norm + most) * 1e-7 + 1


def _table_row(pivots: dict[int, np.ndarray]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "vector"], kind="stable")
        dim = int(rows["dim"].iloc[0])
        x, norm = matrix(rows["vector"], dim), rows["norm"].to_numpy()
        p = pivots.get(dim, np.empty((0, dim)))
        near = distances(x, norm, p)
        y = coordinates(near, norm, p)
        return pd.DataFrame([(dim, rows["centre"].iloc[0], rows["part"].iloc[0], y.min(axis=0), y.max(axis=0),
                              rows["vec_id"].to_numpy(np.int64).tobytes(), x.tobytes(), norm.tobytes(), near.tobytes())],
                            columns=[c.split()[0] for c in TABLE.split(", ")])
    return run


def evaluate(x: np.ndarray, ids: np.ndarray, caps: np.ndarray, q: np.ndarray, own: int, least, k: int) -> tuple[list[tuple], int]:
    """The best ``k`` (score, id) among the candidates that reach ``least``, in the order of their caps; and the number evaluated."""
    order = np.flatnonzero(~(caps < least) & (ids != own))      # a cap that is not a number leaves nothing out
    order = order[np.argsort(-np.nan_to_num(caps[order], nan=np.inf), kind="stable")]
    best: list[tuple] = []
    at = 0
    while at < len(order) and (len(best) < k or not caps[order[at]] < best[-1][0]):
        part = order[at:at + STEP]
        best = sorted(best + list(zip((x[part] @ q).tolist(), ids[part].tolist())), key=lambda s: (-s[0], s[1]))[:k]
        at += STEP
    return [b for b in best if b[0] >= least], min(at, len(order))


def _cell(k: int, pivots: dict[int, np.ndarray]):
    def run(queries: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], 0
        if len(queries) and len(tables):
            t = tables.iloc[0]
            dim = int(t["dim"])
            ids, norm = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["norms"], np.float64)
            x = np.frombuffer(t["vectors"], np.float64).reshape(len(ids), dim)
            p = pivots.get(dim, np.empty((0, dim)))
            y = coordinates(np.frombuffer(t["distances"], np.float64).reshape(len(ids), len(p)), norm, p)
            q, q_norm = matrix(queries["vector"], dim), queries["norm"].to_numpy()
            yq = coordinates(distances(q, q_norm, p), q_norm, p)
            kind = score_type(x, q)
            x, q = as_type(x, kind), as_type(q, kind)
            slack = _slack(q_norm, float(norm.max()))
            least = queries["least"].to_numpy(np.float64)
            own = queries["query_id"].to_numpy()
            for s in range(0, len(queries), QUERY_STEP):
                caps = y @ yq[s:s + QUERY_STEP].T + slack[s:s + QUERY_STEP]
                for i in range(caps.shape[1]):
                    best, n = evaluate(x, ids, caps[:, i], q[s + i], int(own[s + i]), least[s + i], k)
                    out += [(int(own[s + i]), v, Decimal(max(-MOST, min(MOST, int(score)))), None) for score, v in best]
                    taken += n
            out.append((None, None, None, taken))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "taken"]).astype({"query_id": "Int64", "vec_id": "Int64", "taken": "Int64"})
    return run


def _box_cap(q: Column, low: Column, high: Column) -> Column:
    """The largest inner product of the coordinates ``q`` with any in the box."""
    terms = F.zip_with(q, F.arrays_zip(low.alias("low"), high.alias("high")), lambda v, b: F.greatest(v * b["low"], v * b["high"]))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def _visits(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Rows FOUND of all cells that are visited, and the queries."""
    rows = write_table(whole_vectors(vectors), "whole-vectors")
    pivots = choose_pivots(rows)
    rows = write_table(blocks(rows, BLOCK), "blocks")
    tables = write_table(rows.groupBy(*KEY).applyInPandas(_table_row(pivots), TABLE), "pivot-table")

    @F.pandas_udf("array<double>")
    def place(dim: pd.Series, vector: pd.Series, norm: pd.Series) -> pd.Series:
        out = []
        for d, v, n in zip(dim, vector, norm):
            p = pivots.get(int(d), np.empty((0, int(d))))
            one = np.array([n])
            out.append(coordinates(distances(np.frombuffer(v, np.float64)[None, :], one, p), one, p)[0])
        return pd.Series(out)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "dim", "norm", "centre", "part")).alias("v")) \
        .select(F.col("vec_id").alias("query_id"), "v.*").withColumn("coordinates", place("dim", "vector", "norm"))
    queries = write_table(queries, "queries")

    def visit(pairs: DataFrame) -> DataFrame:
        pairs = write_table(pairs.select(*KEY, "query_id", "vector", "norm", "least"), "visits")
        load = pairs.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("cells"))
        left = lookup_join(pairs, load, KEY).withColumn("cell", F.pmod(F.xxhash64("query_id"), F.col("cells"))).drop("cells")
        right = tables.drop("low", "high").join(load, KEY) \
            .withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")
        return write_table(left.groupBy(*KEY, "cell").cogroup(right.groupBy(*KEY, "cell")).applyInPandas(
            lambda q, t: _cell(k, pivots)(q, t), FOUND), "found")

    first = visit(queries.withColumn("least", F.lit(float("-inf"))))
    kth = first.where("query_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")) \
        .select("query_id", F.when(F.col("n") >= k, F.col("kth").cast("double")).alias("kth"))
    # a threshold may be below its score by the rounding to a double, never above
    least = F.when(F.col("kth").isNotNull(), F.col("kth") - F.abs("kth") * 1e-12)
    known = lookup_join(queries, kth, ["query_id"], "left").withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
    boxes = tables.select(*KEY, "low", "high").withColumnsRenamed({"centre": "c", "part": "p"})
    pairs = known.join(boxes, "dim").where("centre <> c or part <> p")      # each stated query against every block
    size = F.element_at("high", -1) * F.element_at("high", -1) + F.aggregate(
        F.arrays_zip("low", "high"), F.lit(0.0), lambda s, b: s + F.greatest(b["low"] * b["low"], b["high"] * b["high"]))
    cap = _box_cap(F.col("coordinates"), F.col("low"), F.col("high")) + (F.col("norm") + size) * 1e-7 + 1
    pairs = pairs.where(~(cap < F.col("least"))).drop("centre", "part").withColumnsRenamed({"c": "centre", "p": "part"})
    return first.unionByName(visit(pairs)), rows


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` best candidates of every query by integer inner product: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and embedding, of which every component x counts as floor(256 * x).  Queries are the
    rows whose vec_id is divisible by ``every``, candidates all rows but those of the query's own id; only vectors
    of the query's length meet it.  Ties go to the smaller vec_id.  Rows with a null id, vector or component or a
    non-finite component take no part; finite components of any size do.  Of rows that repeat an id, each is a
    candidate, and the smallest vector (in bytes) is the query.  Scores beyond 64 bits stop at their limits, and
    beyond 38 digits also in the ranking.
    """
    found, _ = _visits(vectors, k, every)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.where("query_id is not null").withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", as_long(F.col("score")).alias("score"))


def search_work(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """One row: scores that an exhaustive search takes, and those that this one takes."""
    found, rows = _visits(vectors, k, every)
    same = rows.groupBy("dim").agg(F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q"), F.count(F.lit(1)).alias("n"))
    all_ = same.agg(F.sum(F.col("q") * (F.col("n") - 1)).alias("all"), F.lit(0).cast("long").alias("taken"))
    return all_.unionByName(found.agg(F.lit(0).cast("long").alias("all"), F.sum("taken").alias("taken"))) \
        .agg(F.sum("all").alias("scores"), F.sum("taken").alias("scores_taken"))
