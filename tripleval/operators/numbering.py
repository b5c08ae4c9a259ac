"""Global 1-based numbering without a single-partition window.

``rank_global`` range-partitions by the order key, sorts inside each
partition, numbers rows locally, and adds the prefix sum of the partition
sizes.  The partition-size table has one row per range partition (a bound we
choose), so it is broadcast.  The ranged table is checkpointed to the shared
checkpoint folder first: range bounds come from a sample, and re-sampling in a
second evaluation could move rows between partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, write_table

_POS_SHIFT = 33  # monotonically_increasing_id puts the partition index above bit 33


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def rank_global(df: DataFrame, order_cols: Sequence[str | Column], rank_col: str = "rank",
                start: int = 1, partitions: int | None = None, spread_ties: bool = True, stored: bool = False) -> DataFrame:
    """Add ``rank_col`` = position in ``order_cols`` order.

    Ties (rows equal on every order column) take the order of a row hash when
    ``spread_ties``; that also lets the range partitioner split a value shared
    by many rows instead of sending them all to one partition.  ``stored``: the rows are kept as a Parquet table,
    which takes less space than a checkpoint and is read by column; their types must be Parquet's.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(order_cols)
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    if spread_ties and hashable:
        order = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in hashable])]
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    ranged = write_table(ranged, "ranked") if stored else cut_lineage(ranged)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("bigint"), _POS_SHIFT)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, (F.col("_off") + local + F.lit(start)).cast("bigint"))
            .drop("_pid", "_pos", "_off"))


def numbered(df: DataFrame, name: str, col: str) -> DataFrame:
    """``df`` written as table ``name``, with numbers from 0 without gaps in ``col``, in no given order."""
    stored = write_table(df.withColumn("_pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("_pos", _POS_SHIFT)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_pos") - F.shiftleft("_pid", _POS_SHIFT)
    return stored.withColumn("_pid", part).join(F.broadcast(offsets), "_pid") \
        .withColumn(col, F.col("_off") + local).drop("_pid", "_pos", "_off")


def hash_bucket_cut(df: DataFrame, hash_col: str, tie_col: str, cut: Column, digits: int = 5,
                    flag_col: str = "_below") -> DataFrame:
    """Flag rows whose rank in (hash, tie) order is <= ``cut``.

    ``hash_col`` is a hex digest, so its first ``digits`` characters split the
    rows into 16**digits near-equal buckets.  Bucket sizes and their prefix sums
    form a table of at most 16**digits rows; the one bucket that holds the
    cut-th row is numbered, which gives that row's (hash, tie).  Both steps read
    the two key columns alone; the rows themselves are compared with that one
    value in a map-only projection.  ``cut`` may reference ``_total``.
    """
    keys = df.select(F.col(hash_col).alias("_hash"), F.col(tie_col).alias("_tie"), F.substring(hash_col, 1, digits).alias("_b"))
    sizes = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (sizes.select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(Window.partitionBy()).alias("_total"))
              .withColumn("_cut", cut.cast("bigint"))
              .where((F.col("_start") < F.col("_cut")) & (F.col("_start") + F.col("_n") >= F.col("_cut"))))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_hash", "_tie"))
    last = (keys.join(F.broadcast(bounds), "_b").withColumn("_rank", F.col("_start") + rank)
            .where(F.col("_rank") == F.col("_cut")).select(F.struct("_hash", "_tie").alias("_last")))
    place = F.struct(F.col(hash_col).alias("_hash"), F.col(tie_col).alias("_tie"))
    return df.withColumn(flag_col, F.coalesce(place <= last.scalar(), F.lit(False)))


def progress_index(models: DataFrame, order_col: str = "idx") -> DataFrame:
    """``Model i/N``: 1-based position in the registry and registry size."""
    ranked = rank_global(models, [order_col, "model_id"], rank_col="i")
    total = models.agg(F.count(F.lit(1))).scalar()  # scalar subquery, not a join
    return ranked.select("model_id", "i", total.alias("n"))
