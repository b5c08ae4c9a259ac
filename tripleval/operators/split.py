"""Deterministic train / validation split and dataset assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import hash_bucket_cut


def split_hash(id_col: str, seed: int) -> F.Column:
    """Shuffle key: md5 of ``'{seed}|{id}'`` (same digest in Spark and DuckDB)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.raise_error(F.lit(f"{id_col} must not be null: a row without id has no place")))
    return F.md5(F.concat(F.lit(f"{seed}|"), text))


def sql_split_hash(id_expr: str, seed: int) -> str:
    return f"md5('{seed}|' || CAST({id_expr} AS VARCHAR))"


def seeded_split(df: DataFrame, id_col: str, seed: int = 42, val_fraction: float = 0.30,
                 train_label: str = "train", val_label: str = "id_val", split_col: str = "split",
                 digits: int = 5) -> DataFrame:
    """First ``floor(n * (1 - val_fraction))`` rows in hash order are train, the rest validation.

    A pure function of (seed, id): stable under input order and partitioning.
    ``n * (1 - val_fraction)`` is IEEE double arithmetic, so 90 rows at 0.30
    give 62 training rows, not 63.  ``digits`` hex digits of the hash form up to
    16**digits buckets; only the one straddling the cut (about n / 16**digits
    rows) is numbered by a window, so 5 digits keep that task small up to
    around 10**12 rows.  The result does not depend on ``digits``.
    """
    keep = 1.0 - val_fraction
    hashed = df.withColumn("_h", split_hash(id_col, seed))
    flagged = hash_bucket_cut(hashed, "_h", id_col, F.floor(F.col("_total") * F.lit(keep)), digits=digits)
    return (flagged.withColumn(split_col, F.when(F.col("_below"), F.lit(train_label)).otherwise(F.lit(val_label)))
            .drop("_h", "_below"))


def sql_seeded_split(source: str, id_col: str, seed: int = 42, val_fraction: float = 0.30,
                     train_label: str = "train", val_label: str = "id_val") -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {sql_split_hash(id_col, seed)}, {id_col})
            <= floor(count(*) OVER () * (1.0::DOUBLE - {val_fraction}::DOUBLE))
            THEN '{train_label}' ELSE '{val_label}' END AS split FROM ({source})"""


def assemble_datasets(id_examples: DataFrame, od_examples: DataFrame) -> DataFrame:
    """ID = {train, id_val}; OD = {the same train, od_val}: one table with a ``split`` column."""
    od = od_examples.withColumn("split", F.lit("od_val"))
    return id_examples.unionByName(od, allowMissingColumns=True)


def split_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
