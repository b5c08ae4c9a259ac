"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Per document: the distinct five-word shingles, 256 minima, of which the low two bits are
   packed into eight 64-bit words, and the band keys of whole minima: 36 bands of seven at a
   threshold of 0.85 or more, 42 bands of six below, down to 0.8.
2. Documents with equal sets form a class; one representative stands for it from here on.
3. Representatives that share a band are compared by bit counts: equal two-bit lanes, corrected
   for chance collisions.  A bucket gives a spanning forest of its likely pairs, never all pairs.
4. Components of those forests are clusters; only their texts travel.  Within a cluster the pairs
   above the estimate's safety margin are confirmed on full sets, likeliest first; pairs that are
   connected already need no check, as only the components are asked for.
5. Components of the confirmed links give the groups.

A pair at the threshold shares no band with probability 1e-6 (3e-6 at 0.8), and is estimated below
the margin of five standard deviations with probability 3e-7.  Large buckets and clusters are cut into
blocks, and every pair of blocks is a task, so that nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import lookup_join
from .components import connected_components
from .shingles import give_back, shingle_sets

HASHES = 256
BITS = 2
PERCENT = 85
# (least percent, bands, minima a band): the layout of the highest threshold that ``percent`` reaches.
LAYOUTS = ((85, 36, 7), (80, 42, 6))
SHINGLE = 5
# The estimate's standard deviation at the threshold: sqrt(p (1 - p) / 256) / (1 - 1/4) with p = J + (1 - J) / 4.
MARGIN = 5
BUCKET_BLOCK = 1500
BUCKET_GROUP = 40_000
CLUSTER_SHINGLES = 300_000

SIGNED = "doc_id long, set_key binary, n_shingles long, signature binary, bands array<long>"


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return (rng.integers(0, 1 << 32, HASHES, dtype=np.uint32),
            rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))


def minima(shingles: np.ndarray, xor: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The 256 minima of a set: of (x xor c) * a on 32 bits, where x is the hash's high half."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 2048):
        part = (x[None, s:s + 2048] ^ xor[:, None]) * odd[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def pack_low_bits(low: np.ndarray) -> bytes:
    """Lane i of word w holds the low two bits of minimum 32 w + i."""
    lanes = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (last axis: words), by bit counts, corrected for
    the lanes that agree by chance."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def cutoff(percent: int = PERCENT) -> float:
    j, c = percent / 100, 1 / (1 << BITS)
    p = j + (1 - j) * c
    return j - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - c)


def layout(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, minima a band) for a threshold."""
    for least, n_bands, rows in LAYOUTS:
        if percent >= least:
            return n_bands, rows
    raise ValueError(f"no bands are laid out for a threshold of {percent} percent")


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, set_key, n_shingles, signature, bands of every document (columns doc_id, text)."""
    n_bands, band_rows = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, odd = _parameters()
        weights = np.random.default_rng(7).integers(1, 1 << 62, band_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            keys, ns, sigs, bands = [], [], [], []
            for s in shingle_sets(batch.column(1), SHINGLE):
                ns.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    sigs.append(None)
                    bands.append(None)
                    continue
                low = minima(s, xor, odd)
                sigs.append(pack_low_bits(low))
                rows = low[:n_bands * band_rows].reshape(n_bands, band_rows).astype(np.uint64)
                key = (rows * weights).sum(axis=1, dtype=np.uint64) ^ (np.arange(n_bands, dtype=np.uint64) << np.uint64(57))
                bands.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "set_key", "n_shingles", "signature", "bands"])
            give_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, SIGNED)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def likely_pairs(sig: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs i < j at or above ``cut``, a row block at a time."""
    out = []
    for s in range(0, len(sig) - 1, 256):
        est = similarity(sig[s:s + 256, None, :], sig[None, s + 1:, :])
        i, j = np.nonzero(est >= cut)
        keep = j + 1 > i
        out.append((i[keep] + s, j[keep] + s + 1, est[i[keep], j[keep]]))
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(keys: list[pd.Series]) -> Iterator[tuple[int, int]]:
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        v = k.to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change).tolist()
    yield from zip([0, *starts], [*starts, len(change)])


def _bucket_forests(cut: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "pair", "id"], kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint64).reshape(len(rows), -1)
        ids, out = rows["id"].to_numpy(), []
        for s, e in _runs([rows["bucket"], rows["pair"]]):
            i, j, _ = likely_pairs(sig[s:e], cut)
            forest = Forest(e - s)
            out += [(ids[s + a], ids[s + b]) for a, b in zip(i.tolist(), j.tolist()) if forest.join(a, b)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def _confirmed_links(cut: float, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster", "pair", "id"], kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint64).reshape(len(rows), -1)
        ids = rows["id"].to_numpy()
        sets = list(shingle_sets(pa.array(rows["text"], pa.string()), SHINGLE))
        out = []
        for s, e in _runs([rows["cluster"], rows["pair"]]):
            i, j, est = likely_pairs(sig[s:e], cut)
            forest = Forest(e - s)
            for k in np.argsort(-est, kind="stable").tolist():
                a, b = int(i[k]), int(j[k])
                if forest.find(a) == forest.find(b):
                    continue
                x, y = sets[s + a], sets[s + b]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    forest.join(a, b)
                    out.append((ids[s + a], ids[s + b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def _block_pairs(df: DataFrame, blocks: Column) -> DataFrame:
    """One row per pair of blocks that the row's own block belongs to: ``pair`` is a number of the
    unordered pair; a single block is the pair (0, 0)."""
    own = F.pmod(F.xxhash64("id"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return df.withColumn("_blocks", blocks.cast("long")).withColumn("_own", own).withColumn("_other", other) \
        .withColumn("pair", low * F.col("_blocks") + high).drop("_own", "_other")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document (columns ``doc_id``, ``text``): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    Null or empty texts have no shingles and are linked with nothing.  A null doc_id has no
    place in an order of ids: such a row is kept, with a null component_id, and makes no links.
    Rows that repeat a doc_id share its component.  ``percent`` must not be below 80, the
    lowest threshold that bands are laid out for.
    """
    spark = docs.sparkSession
    cut = cutoff(percent)
    signed = write_table(signatures(docs, percent), "minhash")
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key") \
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
             F.first("bands").alias("bands"))
    reps = write_table(reps, "representatives")

    members = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = members.join(sizes, "bucket").join(reps.select("id", "signature"), "id")
    shared = write_table(_block_pairs(shared, F.ceil(F.col("m") / BUCKET_BLOCK)), "buckets")
    n, partitions = shared.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("_blocks") > 1, F.xxhash64("bucket", "pair")).otherwise(
        F.pmod(F.xxhash64("bucket"), F.lit(max(partitions, -(-n // BUCKET_GROUP)))))
    forests = shared.withColumn("_deal", spread).select("_deal", "bucket", "pair", "id", "signature") \
        .groupBy("_deal").applyInPandas(_bucket_forests(cut), "a long, b long")
    clusters = write_table(connected_components(forests), "clusters")

    members = clusters.withColumnRenamed("component", "cluster").join(reps.select("id", "set_key", "n", "signature"), "id")
    weight = members.groupBy("cluster").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    blocks = F.ceil(F.greatest(F.col("_n") / CLUSTER_SHINGLES, F.col("_m") / BUCKET_BLOCK))
    members = write_table(_block_pairs(members.join(weight, "cluster"), blocks), "members")
    total = members.where("_blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    spread = F.when(F.col("_blocks") > 1, F.xxhash64("cluster", "pair")).otherwise(
        F.pmod(F.xxhash64("cluster"), F.lit(max(partitions, -(-total // CLUSTER_SHINGLES)))))
    wanted = members.select(F.col("id").alias("doc_id"), "set_key", "signature", "cluster", "pair", spread.alias("_deal"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = lookup_join(texts, wanted, ["doc_id"], text_cols=("set_key", "signature"))
    links = placed.withColumnRenamed("doc_id", "id").select("_deal", "cluster", "pair", "id", "signature", "text") \
        .groupBy("_deal").applyInPandas(_confirmed_links(cut, percent), "a long, b long")
    groups = write_table(connected_components(links), "groups")

    found = reps.select("set_key", "id").join(groups, "id", "left") \
        .select("set_key", F.coalesce("component", "id").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id (null ids last, then by the hash
    of the text).  Rows of equal id and text are one document, of which the row with the smallest hash of its
    other columns' values stays; null ids count as equal here.  Different texts under one id are documents of
    their own.  Other columns are kept whatever their names and types."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    if ids.where("id is null or m > 1").isEmpty():
        gone = write_table(near_duplicates(docs, percent).where("not kept").select("doc_id"), "duplicates")
        return lookup_join(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)
    # ids do not tell the rows apart: every row gets a number, and one number of each id and text goes on
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("a"),
                       F.xxhash64(F.lit(1), text).alias("b"), F.xxhash64(F.to_json(F.struct("*"))).alias("rank"))
    rows = write_table(rows.withColumn("n", F.monotonically_increasing_id()), "rows")
    one = rows.groupBy("id", "a", "b").agg(F.min(F.struct("rank", "n")).alias("one")).select("id", "a", "b", "one.n")
    one = write_table(one, "distinct-rows")
    found = near_duplicates(lookup_join(rows.select("n", "row.text"), one.select("n"), ["n"], "left_semi")
                            .select(F.col("n").alias("doc_id"), "text"), percent)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "a", "b", "n")
    first = one.join(found.select(F.col("doc_id").alias("n"), "component_id"), "n") \
        .groupBy("component_id").agg(F.min(place).alias("first"))
    kept = write_table(first.select("first.n"), "kept-rows")
    return lookup_join(rows, kept, ["n"], "left_semi").select("row.*")
