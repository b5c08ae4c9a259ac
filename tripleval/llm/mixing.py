"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of equal-token blocks.  Blocks go to sources, and a source's blocks to its shards,
by highest quotients votes / (2 k - 1); within a shard the documents stand in a seeded order and
the quota's blocks are taken from the front, after whole repetitions.  No block is ever a row: a
shard's quota is an integer and the documents find their share by a prefix sum within the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import lookup_join, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1_000_000
ROW_WORDS = 100
SEED = 17


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): the sources, by code point with null last, weigh
    ``weights`` in turn and share ``share`` of all sizes; a target stops at ``most`` times its
    source's size and the excess is shared again by weight.

    The end of that sharing is a water level: target = least(most * size, level * weight).  With
    sources sorted by most * size / weight, the level is the first (total - capped before) /
    (weights from here on) that does not pass its own row's limit; further on it only falls, so
    it is the largest of those.  One row per source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy("_limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(by_limit), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))))
    t = sources.withColumn("weight", w).withColumn("_limit", F.col("source_size") * most / F.col("weight"))
    t = t.withColumn("_level", level)
    t = t.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_limit"), F.col("_level"))).over(everything))
    return t.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("_level") * F.col("weight"))) \
        .drop("_limit", "_level")


def apportion(df: DataFrame, votes: str, seats: Column, group: list[str]) -> DataFrame:
    """Sainte-Laguë: adds ``seats``, dealing each group's number of seats by highest quotients.

    Row i has its first ``base`` seats for sure; only the quotients near its proportional share
    are listed and ranked.  A common divisor moves every share in proportion to its votes, and
    rounding moves the sum by at most half a seat per row, so 2 + (rows / 2) * (share of the
    votes) quotients on either side are enough; all rows of a group list about three each.
    ``seats`` is an expression over the group's columns, equal on all its rows.  Ties go to the
    larger votes, then to the smaller key.
    """
    g = Window.partitionBy(*group)
    total, rows = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    part = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    d = df.withColumn("_seats", seats.cast("long")).withColumn("_part", part).withColumn("_rows", rows)
    near = F.floor(F.col("_part") * F.col("_seats"))
    slack = F.ceil(F.col("_part") * F.col("_rows") / 2) + 2
    d = d.withColumn("_base", F.greatest(F.lit(0), near - slack).cast("long")) \
        .withColumn("_top", (near + slack + 1).cast("long"))
    d = d.withColumn("_left", F.col("_seats") - F.sum("_base").over(g))
    keys = [c for c in df.columns if c != votes]
    q = d.withColumn("_k", F.explode(F.sequence(F.col("_base") + 1, F.col("_top")))) \
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(
        F.col("_quotient").desc(), F.col(votes).desc(), *[F.col(c).asc_nulls_last() for c in keys]))
    won = (F.col("_rank") <= F.col("_left")) & (F.col("_quotient") > 0)
    return q.withColumn("_rank", rank).groupBy(*df.columns) \
        .agg((F.first("_base") + F.sum(won.cast("long"))).alias("seats"))


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _deal(docs: DataFrame, carried: list[Column], weights: tuple[float, ...], share: float, most: int, block: int,
          shard_words: int, seed: int) -> DataFrame:
    sized = [F.col("doc_id").cast("long").alias("_doc_id"), F.col("source").alias("_source"), _key(F.col("source")).alias("_key"),
             n_words(F.col("text")).alias("_size")]
    sizes = write_table(docs.select(*sized), "mix-sizes")
    sources = sizes.groupBy("_key", F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    shards = F.ceil((F.col("source_size") + ROW_WORDS * F.col("_docs")) / F.lit(shard_words)).cast("long")
    plan = targets(sources.withColumn("_shards", shards).drop("_docs"), weights, share, most)
    cells = F.round(F.sum("target").over(Window.partitionBy()) / F.lit(block))
    plan = write_table(apportion(plan.select("_key", "source", "source_size", "_shards", "target"), "target", cells, [])
                       .withColumnsRenamed({"seats": "_blocks", "source_size": "_source_size", "target": "_target"})
                       .drop("source"), "mix-plan")

    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_doc_id").cast("string"), F.lit(""))).cast("binary"))
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        return lookup_join(rows.withColumn("_hash", h), plan, ["_key"], text_cols=("_key",)) \
            .withColumn("_shard", F.pmod(number, F.col("_shards")))

    content = placed(sizes).groupBy("_key", "_shard", "_blocks").agg(F.sum("_size").alias("_shard_size"))
    quotas = apportion(content, "_shard_size", F.col("_blocks"), ["_key", "_blocks"]) \
        .select("_key", "_shard", "_shard_size", F.least(F.col("seats") * block, F.col("_shard_size") * most).alias("_words"))
    quotas = write_table(quotas, "mix-quotas")
    rows = docs.select(*sized, *carried) if carried else sizes
    dealt = lookup_join(placed(rows), quotas, ["_key", "_shard"], text_cols=("_key",))
    front = Window.partitionBy("_key", "_shard").orderBy("_hash", "_doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("_shard_size") > 0, F.floor(F.col("_words") / F.col("_shard_size"))).otherwise(F.lit(0)).cast("long")
    before = F.coalesce(F.sum("_size").over(front), F.lit(0))
    rest = F.col("_words") - whole * F.col("_shard_size")
    taken = whole * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest - before))
    return dealt.withColumn("_taken", taken.cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Words that the mix takes from every document (columns ``doc_id``, ``source``, ``text``).

    Returns doc_id, source, size, source_size, target, taken, shard.  A null text has size 0, a
    null source is a source of its own (last).  A source is split into shards of about
    ``shard_words`` words by the hash of the document's id, so that a hot source is many window
    groups.  The order within a shard is the hash of (seed, doc_id), then doc_id and size; rows
    with equal id and size are interchangeable.  Other columns are ignored.
    """
    dealt = _deal(docs, [], weights, share, most, block, shard_words, seed)
    return dealt.select(F.col("_doc_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
                        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
                        F.col("_shard").alias("shard"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
                  block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as whole documents: the rows of ``docs``, each as often as ``mix`` takes its words, rounded to
    whole copies (one document per shard at most is taken in part).  A document without words is
    in no mix.  The rows travel once, with their shard; nothing is joined by id.
    """
    dealt = _deal(docs, [F.struct("*").alias("_row")], weights, share, most, block, shard_words, seed)
    copies = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    repeated = dealt.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
