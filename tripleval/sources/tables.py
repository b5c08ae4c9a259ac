"""Parquet scans of the given tables with explicit column lists (pruned scans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, spread: bool = False) -> DataFrame:
    """Scan ``name`` keeping only ``cols``.

    ``spread``: for tables whose rows carry heavy per-row text work, a scan
    with fewer splits than the cluster has cores (a file stored as one row
    group) is spread round-robin over ``defaultParallelism`` partitions.  A
    large input already has enough splits and is left as it is.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if cols:
        df = df.select(*cols)
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    return df
