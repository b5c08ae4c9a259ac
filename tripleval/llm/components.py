"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_split_join
from ..session import write_table
from .common import BROADCAST_BYTES, ROW_OVERHEAD


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
    return r["n"], r["h"]


def _with_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``edges`` with their vertex's least neighbour: there are at most 2 ``n`` vertices, of two numbers each."""
    row = ROW_OVERHEAD + 16
    if 2 * n * row <= BROADCAST_BYTES:
        return edges.join(F.broadcast(low), "a")
    return skew_split_join(edges, low, ["a"], 1, limit=BROADCAST_BYTES // row)


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id reachable.

    Each step writes the edge table to the shared folder.  A large star hangs a vertex's larger
    neighbours on its smallest one, a small star the smaller neighbours; both keep the
    components, and the edges end as one star per component.  The minima are grouped with a
    partial aggregation.  A star's centre is a hot key of the join with its minimum: small tables of minima
    are broadcast, beyond that centres of many edges join apart from the others, map-side.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = write_table(e, "cc")
    before = _state(e)
    for _ in range(max_steps):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both.where("b > a"), low, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = write_table(large, "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, low, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = write_table(small, "cc")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
