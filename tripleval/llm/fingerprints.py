"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word shingle is hashed once; the hash's top bits choose one of ``BINS`` bins and a bin
keeps its minimum.  An empty bin takes the minimum of a filled one by optimal densification: bin
i tries the bins in its own fixed random order, here (c_i j + d_i) mod BINS with odd c_i, and
takes the first filled one.  The low ``BITS`` bits of all bins are packed into 64-bit words.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, words

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
BITS = 8
SHINGLE = 5
SEED = 5
BLOCK_LOG2 = 10
SINGLE_TASK_BLOCKS = 50_000

_LANES = 64 // BITS
_LOW = (1 << BITS) - 1
_LANE_BIT = 0x0101010101010101


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the ``size``-word shingles of a text; fewer words are one shingle, none are none."""
    def grams(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.slice(h, F.lit(1), F.greatest(n - (size - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), grams)


def bin_minima(hashes: Column) -> Column:
    """The least hash of every filled bin."""
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BINS_LOG2)
    return _let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def densified(minima: Column) -> Column:
    """The minimum of each of the ``BINS`` bins; empty bins borrow from filled ones."""
    rng = random.Random(SEED)
    c = F.array(*[F.lit(2 * rng.randrange(BINS // 2) + 1).cast("long") for _ in range(BINS)])
    d = F.array(*[F.lit(rng.randrange(BINS)).cast("long") for _ in range(BINS)])
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BINS_LOG2)
    low = (1 << 48) - 1

    def fill(m: Column) -> Column:
        def borrowed(i: Column) -> Column:
            # the trial number of each filled bin above the value's low bits: the least is the first filled one
            factor, shift = F.get(c, i), F.get(d, i)
            return F.array_min(F.transform(m, lambda x: F.shiftleft((factor * bin_of(x) + shift).bitwiseAND(BINS - 1), 48).bitwiseOR(
                x.bitwiseAND(low))))

        def sparse(own: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(
                F.try_element_at(own, i.cast("long")), borrowed(i)))

        some = _let(F.map_from_arrays(F.transform(m, bin_of), m), sparse)
        in_order = F.concat(F.filter(m, lambda x: x >= 0), F.filter(m, lambda x: x < 0))
        return F.when(F.size(m) == BINS, in_order).otherwise(some)

    return _let(minima, fill)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text: array of 64-bit words, bin 0 in the highest lane of the first.
    A null or wordless text has an empty one; equal texts have equal ones."""
    def pack(bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), lambda w: F.aggregate(
            F.slice(bins, w * _LANES + 1, F.lit(_LANES)), F.lit(0).cast("long"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(_LOW))))

    def whole(m: Column) -> Column:
        return F.when(F.size(m) == 0, F.array().cast("array<bigint>")).otherwise(_let(densified(m), pack))

    return _let(bin_minima(shingle_hashes(text)), whole)


def fingerprint_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: the share of equal lanes, corrected for
    those that agree by chance, from 0 to 1.  Two empty ones are alike (1), an empty and a filled
    one are not (0)."""
    def differ(x: Column, y: Column) -> Column:
        t = x.bitwiseXOR(y)
        for s in (4, 2, 1):
            t = t.bitwiseOR(F.shiftrightunsigned(t, s))
        return F.bit_count(t.bitwiseAND(F.lit(_LANE_BIT)))

    unequal = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    share = ((1 - unequal / F.lit(float(BINS))) - chance) / (1 - chance)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def next_heads(heads: DataFrame) -> DataFrame:
    """(block, next_head) for (block, head): the head of the next lower block, of the highest for the
    lowest.  Many blocks are put into blocks of blocks first, so that one task sorts at most
    ``SINGLE_TASK_BLOCKS`` rows."""
    if heads.count() <= SINGLE_TASK_BLOCKS:
        order = Window.orderBy(F.col("block").desc())
        return heads.select("block", F.coalesce(F.lead("head").over(order), F.max("head").over(Window.partitionBy())).alias("next_head"))
    grouped = heads.withColumn("_up", F.shiftright("block", BLOCK_LOG2))
    above = next_heads(grouped.groupBy("_up").agg(F.max("head").alias("head")).withColumnRenamed("_up", "block")) \
        .withColumnsRenamed({"block": "_up", "next_head": "_far"})
    order = Window.partitionBy("_up").orderBy(F.col("block").desc())
    return grouped.withColumn("_near", F.lead("head").over(order)).join(above, "_up") \
        .select("block", F.coalesce("_near", "_far").alias("next_head"))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<c>`` of every carried column c: its value in the document
    that follows in descending order of doc_id, and after the last the first.

    Rows of one block of ids (1024 consecutive numbers) are sorted together; the first document of a
    block is sent to the block before as well, which needs it as its last follower.  Rows of equal
    doc_id follow each other by text.  A null doc_id has no place in the order and no follower.
    """
    block = F.shiftright(F.col("doc_id"), BLOCK_LOG2)
    placed = docs.where(F.col("doc_id").isNotNull())
    heads = placed.select("doc_id").groupBy(block.alias("block")).agg(F.max("doc_id").alias("head"))
    links = next_heads(heads).select(F.col("next_head").alias("doc_id"), F.col("block").alias("_to"))
    home = F.struct(block.alias("block"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_to").alias("block"), F.lit(1).alias("guest"))
    sent = lookup_join(placed, links, ["doc_id"], "left") \
        .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(home)).otherwise(F.array(home, guest)))) \
        .select(*docs.columns, F.col("_at.block").alias("_block"), F.col("_at.guest").alias("_guest"))
    order = Window.partitionBy("_block").orderBy("_guest", F.col("doc_id").desc(), "text")
    found = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("_guest = 0").drop("_block", "_guest")
    alone = docs.where(F.col("doc_id").isNull())
    types = dict(docs.dtypes)
    return found.unionByName(alone.select("*", *[F.lit(None).cast(types[c]).alias(f"next_{c}") for c in carried]))
