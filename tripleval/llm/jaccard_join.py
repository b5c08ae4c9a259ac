"""Exact Jaccard join of documents on word n-grams, by prefix trees.

1. A document is the set of its n-gram hashes.  Documents with equal sets form a class that one
   representative stands for.
2. One global order of grams: those whose hash lies in the lowest quarter (``COUNTED``) are counted in
   all sets and come first, rare ones before frequent ones; then the others by hash; last the counted
   ones of ``HOT`` or more sets, so that a licence line or a shared passage joins nothing.  Two sets
   whose similarity reaches the threshold t share a gram within their first n - ceil(t n) + 1.  A set
   with as many counted grams of its own is done; of the others only prefix grams travel.  The few
   sets without as many cool counted grams read on, past the lowest quarter.
3. A gram's sets of comparable size meet at home, the smallest of their numbers.  Near copies
   share most prefix grams and hence few homes, so a set travels about once, not once per gram.
4. At home the sets are stored in a trie.  All probes descend it together: a path's overlap is
   computed once for every set below it, and a subtree is left when its sets, with all that remains
   of them and of the probe, can't reach the threshold.  Leaves hold exact overlaps.
   A pair that meets at several homes counts at the smallest.
5. A task returns the number of links of each set and a spanning forest of them, never the pairs.

Homes of many sets are cut into blocks, and every pair of blocks is a task: nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, write_table
from .common import lookup_join
from .components import connected_components
from .shingles import give_back, shingle_sets

PERCENT = 90
SHINGLE = 3
# Grams with a hash below this share of all hashes are counted over the whole corpus.
COUNTED = 1 / 4
# Sets that make a counted gram hot.
HOT = 100
# Sets and grams of a home's block.
BLOCK_SETS = 1500
BLOCK_GRAMS = 600_000
# Grams of a chain between two checks of the bounds; bytes of the table of probes and grams.
STRIDE = 64
TABLE_BYTES = 32 << 20

SIGNED = "doc_id long, text_hash long, set_key binary, n long, low array<long>"
LINKS = "a long, b long, links long"


def prefix_length(n, percent: int = PERCENT):
    """Grams of a set of ``n`` of which a set at the threshold must share one (numbers or columns)."""
    least = F.floor((n * percent + 99) / 100) if not isinstance(n, (int, np.integer)) else (n * percent + 99) // 100
    return n - least + 1


def _size_class(n, percent: int):
    """Sets at the threshold are of the same or of neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / (1.0001 * math.log(100 / percent))).cast("int")


def _limit() -> np.uint64:
    return np.uint64(int(COUNTED * (1 << 64)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("text_hash", F.xxhash64("text"))


def signed_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per document: a key of its whole set, the set's size, and its grams of the lowest hashes in order."""
    limit = _limit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ns, low = [], [], []
            for s in shingle_sets(batch.column(1), size):
                ns.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low.append(s[:np.searchsorted(s, limit)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()),
                 pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "set_key", "n", "low"])
            give_back()

    return _texts(docs).mapInArrow(run, SIGNED)


def _extended(size: int, percent: int):
    """Prefix grams past the lowest quarter, for sets whose cool low grams are fewer than the prefix:
    the higher hashes in order, then the set's hot grams."""
    limit = _limit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums, grams = [], []
            for num, hot, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), size)):
                cut = int(np.searchsorted(s, limit))
                late = np.sort(np.array(hot or [], np.int64).view(np.uint64))
                want = prefix_length(len(s), percent) - (cut - len(late))
                more = np.concatenate([s[cut:], late])[:max(0, want)]
                nums.append(np.full(len(more), num, np.int64))
                grams.append(more.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nums) if nums else [], pa.int64()),
                                              pa.array(np.concatenate(grams) if grams else [], pa.int64())], names=["num", "gram"])
            give_back()

    return run


def prefix_grams(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """num, n, gram: the prefix of every representative in the global order, without grams that no other set has."""
    length = prefix_length(F.col("n"), percent)
    grams = reps.select("num", F.explode("low").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    grams = write_table(grams.join(counts, "gram"), "grams")
    hot = F.col("sets") >= HOT
    shared = grams.groupBy("num").agg(F.count(F.lit(1)).alias("shared"), F.count(F.when(hot, 1)).alias("hot"))
    sizes = reps.select("num", "n", "doc_id", "text_hash", F.size("low").alias("low")).join(shared, "num", "left") \
        .fillna(0, ["shared", "hot"]).withColumn("alone", F.col("low") - F.col("shared"))
    # a set with enough grams of its own has no other prefix
    open_ = write_table(sizes.where(F.col("alone") < length), "open-sets")
    place = F.row_number().over(Window.partitionBy("num").orderBy("sets", "gram"))
    cool = lookup_join(grams.where(~hot), open_.where("shared > hot").select("num", "n", "alone"), ["num"]) \
        .withColumn("place", F.col("alone") + place).where(F.col("place") <= length)
    late = lookup_join(grams.where(hot), open_.where("hot > 0").select("num"), ["num"]).groupBy("num").agg(F.collect_list("gram").alias("late"))
    short = open_.where(F.col("low") - F.col("hot") < length).join(late, "num", "left").select("num", "n", "doc_id", "text_hash", "late")
    short = write_table(short, "short-prefixes")
    texts = lookup_join(_texts(docs), short, ["doc_id", "text_hash"], array_cols=("late",)).select("num", "late", "text")
    more = texts.mapInArrow(_extended(size, percent), "num long, gram long").join(short.select("num", "n"), "num")
    return cool.select("num", "n", "gram").unionByName(more.select("num", "n", "gram"))


def homes(prefixes: DataFrame, percent: int) -> DataFrame:
    """home, num, n, probe, earlier: the sets that meet at each home.

    ``earlier`` lists the set's smaller homes.  Where most sets of a home also met at one earlier
    home, only the others need to probe; a home where all met before is left out."""
    kind = _size_class(F.col("n"), percent)
    cells = write_table(prefixes.withColumn("kind", F.explode(F.array(kind, kind + 1))).dropDuplicates(["gram", "kind", "num"]),
                        "prefixes")
    meets = cells.groupBy("gram", "kind").agg(F.min("num").alias("home"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = write_table(cells.join(meets, ["gram", "kind"]).select("home", "num", "n").distinct(), "homes")
    own = members.groupBy("num").agg(F.sort_array(F.collect_list("home")).alias("all"))
    members = members.join(own, "num").withColumn("first", F.col("all")[0])
    votes = members.where("first < home").groupBy("home", "first").agg(F.count(F.lit(1)).alias("votes"))
    lead = votes.groupBy("home").agg(F.max(F.struct("votes", "first"))["first"].alias("lead"))
    members = members.join(lead, "home", "left") \
        .withColumn("probe", F.coalesce(~F.array_contains("all", F.col("lead")), F.lit(True))) \
        .withColumn("earlier", F.filter("all", lambda h: h < F.col("home")))
    return members.select("home", "num", "n", "probe", "earlier")


class Trie:
    """Sets of codes in a path-compressed prefix tree, kept as sorted sequences and the lengths of their common prefixes."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1      # a gram of one set overlaps with nothing here
        number = np.cumsum(shared) - 1
        self.width = int(shared.sum())
        ends = np.cumsum([len(s) for s in sets])
        seqs = [number[c[shared[c]]].astype(">u4") for c in np.split(code, ends[:-1])]
        self.order = sorted(range(len(sets)), key=lambda k: seqs[k].tobytes())
        self.seqs = [seqs[k].astype(np.int64) for k in self.order]
        self.sizes = np.array([len(sets[k]) for k in self.order], np.int64)
        self.filled = np.array([len(s) for s in self.seqs], np.int64)
        self.common = np.zeros(len(sets), np.int64)
        for k in range(1, len(sets)):
            a, b = self.seqs[k - 1], self.seqs[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[k] = differ[0] if len(differ) else m

    def probe(self, probes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, places): each stored set with the ``probes`` (places) at the threshold, itself among them."""
        width = max(1, self.width)
        step = max(1, TABLE_BYTES // width)
        for s in range(0, len(probes), step):
            yield from self._descend(probes[s:s + step], percent, width)

    def _descend(self, probes: np.ndarray, percent: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
        own = [self.seqs[k] for k in probes.tolist()]
        filled, size = self.filled[probes], self.sizes[probes]
        start = np.cumsum(filled) - filled
        row = np.repeat(np.arange(len(probes)), filled)
        flat = np.concatenate(own) if own else np.empty(0, np.int64)
        places = row * width + flat                       # sorted: the probes' codes, probe by probe
        table = np.zeros((width, len(probes)), np.uint8)
        table[flat, row] = 1
        stack = [(0, len(self.seqs), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            end = int(self.filled[lo]) if hi - lo == 1 else int(self.common[lo + 1:hi].min())
            least, most = int(self.sizes[lo:hi].min()), int(self.filled[lo:hi].max())
            chain = self.seqs[lo][depth:end]
            for c in range(0, len(chain), STRIDE):
                part = chain[c:c + STRIDE]
                seen = table[part].sum(axis=0, dtype=np.int64) if len(alive) == len(probes) else \
                    table[part[:, None], alive[None, :]].sum(axis=0, dtype=np.int64)
                overlap = overlap + seen
                depth += len(part)
                left = start[alive] + filled[alive] - np.searchsorted(places, alive * width + part[-1], side="right")
                reach = overlap + np.minimum(left, most - depth)
                keep = (100 + percent) * reach >= percent * (size[alive] + least)
                alive, overlap = alive[keep], overlap[keep]
                if not len(alive):
                    break
            if not len(alive):
                continue
            if hi - lo == 1:
                keep = (100 + percent) * overlap >= percent * (size[alive] + least)
                yield lo, probes[alive[keep]]
                continue
            cuts = [lo, *(np.flatnonzero(self.common[lo + 1:hi] == end) + lo + 1).tolist(), hi]
            stack += [(a, b, end, alive, overlap) for a, b in zip(cuts, cuts[1:])]


def linked(sets: list[np.ndarray], probe: np.ndarray, block: np.ndarray | None, weight: np.ndarray, earlier: list[frozenset],
           percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each set, spanning forest) over the pairs that hold a probe, are of two blocks if blocks
    are given, and did not meet at an earlier home."""
    trie = Trie(sets)
    order = np.array(trie.order)
    probe, weight = probe[order], weight[order]
    block = None if block is None else block[order]
    met = np.array([bool(earlier[k]) for k in order.tolist()])
    links, label, forest = np.zeros(len(sets), np.int64), np.arange(len(sets)), []
    for at, found in trie.probe(np.flatnonzero(probe), percent):
        found = found[(found < at) if probe[at] else (found != at)]     # two probes see each other twice
        if block is not None:
            found = found[block[found] != block[at]]
        if met[at] and met[found].any():
            mine = earlier[order[at]]
            found = np.array([k for k in found.tolist() if mine.isdisjoint(earlier[order[k]])], np.int64)
        if not len(found):
            continue
        links[found] += weight[at]
        links[at] += weight[found].sum()
        for other in np.setdiff1d(label[found], label[at]).tolist():
            forest.append((int(order[at]), int(order[found[np.flatnonzero(label[found] == other)[0]]])))
            label[label == other] = label[at]
    out = np.zeros(len(sets), np.int64)
    out[order] = links
    return out, forest


def _joined(size: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.drop_duplicates(["home", "pair", "num"]).groupby(["home", "pair"], sort=False):
            sets = list(shingle_sets(pa.array(g["text"], pa.string()), size))
            nums = g["num"].tolist()
            own = g["own"].to_numpy() if g["crossed"].iloc[0] else None
            links, forest = linked(sets, g["probe"].to_numpy(bool), own, g["members"].to_numpy(np.int64),
                                   [frozenset(x) for x in g["earlier"]], percent)
            out += [(nums[a], nums[b], None) for a, b in forest]
            out += [(nums[k], None, int(links[k])) for k in np.flatnonzero(links).tolist()]
        give_back()
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("Int64")
    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Every set once per pair of blocks that its own block belongs to; a home of one block is the pair 0."""
    weight = members.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"), F.max("probe").alias("any"))
    count = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("long")
    rows = members.join(weight.where("any").select("home", count.alias("blocks")), "home") \
        .withColumn("own", F.pmod(F.xxhash64("num"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")) \
        .withColumn("crossed", F.col("own") != F.col("other")).drop("other")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document (columns ``doc_id``, ``text``): doc_id, n_shingles, component_id, n_links.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``size``-word shingles (A-Z in lower case; a text of fewer words is one shingle).  component_id
    is the smallest doc_id reachable, n_links the number of documents linked directly.  Null or
    empty texts have no shingles and no links.  A null doc_id has no place in an order of ids: such
    a row has no links and a null component_id.  Rows that repeat a doc_id are documents of their own.
    Other columns are not read.  Each set is compared by 64-bit hashes of its shingles.
    """
    spark = docs.sparkSession
    signed = write_table(signed_sets(docs, size), "sets")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"),
        F.first("low").alias("low"))
    reps = write_table(classes.select(F.monotonically_increasing_id().alias("num"), "set_key", "one.*", "members", "n", "low"),
                       "representatives")
    members = write_table(homes(prefix_grams(docs, reps, size, percent), percent), "members")
    placed = write_table(_blocks(members), "placed")
    alone = placed.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    deals = max(shuffle_partitions(spark), -(-alone // BLOCK_GRAMS))
    deal = F.when(F.col("blocks") > 1, F.xxhash64("home", "pair")).otherwise(F.pmod(F.xxhash64("home"), F.lit(deals)))
    wanted = placed.withColumn("deal", deal).join(reps.select("num", "doc_id", "text_hash", "members"), "num")
    wanted = write_table(wanted, "wanted")
    found = lookup_join(_texts(docs), wanted, ["doc_id", "text_hash"], array_cols=("earlier",)) \
        .select("deal", "home", "pair", "own", "crossed", "num", "probe", "earlier", "members", "text") \
        .groupBy("deal").applyInPandas(_joined(size, percent), LINKS)
    found = write_table(found, "links")
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "num")
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "num")
    classes = reps.select("num", "set_key", "doc_id", "members").join(groups, "num", "left").join(links, "num", "left") \
        .withColumn("component", F.coalesce("component", "num"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "component").select(
        "set_key", "component_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    sets = signed.select("doc_id", "n", "set_key")
    some = sets.where("n > 0 and doc_id is not null").join(classes, "set_key", "left")
    none = sets.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"),
                                                         F.lit(0).cast("long").alias("n_links"))
    return some.select("doc_id", "n", "component_id", "n_links").unionByName(none).withColumnRenamed("n", "n_shingles")
