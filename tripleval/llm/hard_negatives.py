"""Hard negatives by exact search in cover trees.

Candidates are dealt into blocks around centres, and each block is a cover tree: a node is a vector
with a covering radius, its children are vectors far apart from each other that cover the node's
vectors with about half the radius.  Vectors are augmented by a last component that gives all
vectors of a block the same norm M, so that for a query q

    2 <q, x> = |q|^2 + M^2 - d(q, x)^2   and   d(q, c) - r <= d(q, x) <= d(q, c) + r,

and a node's radius bounds the inner products below it from both sides.  A search has windows of scores
(the positives' search one that holds all).  It descends best-first, leaves nodes whose bounds lie
outside every window, or below the window's k-th score so far, and nodes without a wanted label,
and takes the exact scores of the vectors it meets.

Anchors meet blocks in cells of bounded size.  Each search visits the anchor's own block first; what
it finds there is the threshold that other blocks' root bounds are held against, before any vector of
theirs is sent.
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

POSITIVES = 5
NEGATIVES = 5
LEAST_SHARE = 80
LABELS = 10
SHIFT_EVERY = 7

# Vectors of a block; anchors of a cell.
BLOCK = 2048
CELL_ANCHORS = 4096
# Children of a node, vectors of a leaf, and nodes opened at once.
CHILDREN = 48
LEAF = 24
OPENED = 16

TREE = ("dim int, centre int, part int, n int, top double, radius double, root array<double>, mask long, ids binary, labels binary, vectors binary, "
        "middle binary, radii binary, masks binary, first binary, last binary")
FOUND = "anchor_id long, hi decimal(38, 0), vec_id long, score decimal(38, 0)"


def _mask(labels: np.ndarray) -> np.ndarray:
    return np.int64(1) << (labels % 63)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(middle, radius, first, last) of the nodes of a tree over the rows of ``points``.

    Node 0 is the root; a node's children are the nodes first to last.  Each child's ``middle`` is a
    row, the first child's that of its parent; every row is the middle of exactly one node without
    children, or of a chain of nodes that ends in one."""
    def distances(rows: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[k]) ** 2).sum(axis=1))

    rows = np.arange(len(points))
    middle, radius, first, last, at = [0], [0.0], [0], [0], 0
    below = [(rows, distances(rows, 0))]
    while at < len(middle):
        rows, near = below[at]
        below[at] = None
        radius[at] = float(near.max())
        if len(rows) > 1:
            own = middle[at]
            if len(rows) <= LEAF or radius[at] == 0:
                kids = [(np.array([k]), np.zeros(1)) for k in [own, *rows[rows != own].tolist()]]
            else:
                part, owner, goal = np.zeros(len(rows), np.int64), [own], radius[at] / 2
                while len(owner) < CHILDREN and near.max() > goal:
                    far = int(np.argmax(near))
                    d = distances(rows, int(rows[far]))
                    closer = d < near
                    closer[far] = True
                    near = np.where(closer, d, near)
                    part[closer] = len(owner)
                    owner.append(int(rows[far]))
                kids = [(rows[part == k], near[part == k]) for k in range(len(owner))]
                kids = [(np.append(own, r[r != own]), np.append(0.0, d[r != own])) if k == 0 else
                        (np.append(owner[k], r[r != owner[k]]), np.append(0.0, d[r != owner[k]])) for k, (r, d) in enumerate(kids)]
            first[at], last[at] = len(middle), len(middle) + len(kids)
            for r, d in kids:
                middle.append(int(r[0]))
                radius.append(0.0)
                first.append(0)
                last.append(0)
                below.append((r, d))
        at += 1
    return np.array(middle, np.int32), np.array(radius), np.array(first, np.int32), np.array(last, np.int32)


def _tree_row(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "label", "vector"], kind="stable")
    dim = int(rows["dim"].iloc[0])
    x, norm, labels = matrix(rows["vector"], dim), rows["norm"].to_numpy(), rows["label"].to_numpy(np.int64)
    top = float(norm.max())
    with np.errstate(over="ignore", invalid="ignore"):
        middle, radii, first, last = cover_tree(np.nan_to_num(np.column_stack([x, np.sqrt(np.maximum(0, top - norm))])))
    masks = _mask(labels)[middle]
    for k in range(len(middle) - 1, -1, -1):
        for child in range(first[k], last[k]):
            masks[k] |= masks[child]
    return pd.DataFrame([(dim, rows["centre"].iloc[0], rows["part"].iloc[0], len(rows), top, radii[0], x[0], masks[0],
                          rows["vec_id"].to_numpy(np.int64).tobytes(), labels.tobytes(), x.tobytes(), middle.tobytes(), radii.tobytes(),
                          masks.tobytes(), first.tobytes(), last.tobytes())], columns=[c.split()[0] for c in TREE.split(", ")])


def descend(tree: dict, q: np.ndarray, norm: float, label: int, same: bool, own: int, lows: list, highs: list, k: int, kind: type
            ) -> tuple[list[list[tuple]], int]:
    """For each window of scores (low to high, both included) the best ``k`` vectors (score, vec_id) of the wanted labels; and
    the number of scores taken."""
    x, ids, labels = tree["x"], tree["ids"], tree["labels"]
    middle, radii, masks, first, last = (tree[c] for c in ("middle", "radii", "masks", "first", "last"))
    both = norm + tree["top"]
    slack = both * 1e-9 + 1
    bit = np.int64(1) << np.int64(label % 63)
    best: list[list[tuple]] = [[] for _ in lows]
    floor = list(lows)                          # what a score must reach to count

    def offer(rows: np.ndarray, scores: np.ndarray) -> None:
        good = (labels[rows] == label) & (ids[rows] != own) if same else labels[rows] != label
        rows, scores = rows[good], scores[good]
        for w in range(len(best)):
            fit = (scores >= floor[w]) & (scores <= highs[w])
            if fit.any():
                both_ = best[w] + list(zip(scores[fit].tolist(), ids[rows[fit]].tolist()))
                best[w] = sorted(both_, key=lambda p: (-p[0], p[1]))[:k]
                if len(best[w]) == k:
                    floor[w] = max(floor[w], best[w][-1][0])

    def bounds(nodes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(np.maximum(0, both - 2 * scores.astype(np.float64)))
        gap, reach = np.maximum(0, d - radii[nodes]), d + radii[nodes]
        return (both - gap * gap) / 2 + slack, (both - reach * reach) / 2 - slack

    def wanted(nodes: np.ndarray, cap: np.ndarray, least: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(nodes), bool)
        for w in range(len(best)):
            inside |= ~((cap < floor[w]) | (least > highs[w]))      # a bound that is not a number leaves nothing out
        return inside & (((masks[nodes] & bit) != 0) if same else ((masks[nodes] & ~bit) != 0) | (masks[nodes] == bit))

    nodes = np.zeros(1, np.int64)
    scores = x[middle[nodes]] @ q
    taken = 1
    offer(middle[nodes], scores)
    cap, least = bounds(nodes, scores)
    open_ = np.flatnonzero(last[nodes] > first[nodes])
    nodes, scores, cap, least = nodes[open_], scores[open_], cap[open_], least[open_]
    while len(nodes):
        keep = wanted(nodes, cap, least)
        nodes, scores, cap, least = nodes[keep], scores[keep], cap[keep], least[keep]
        if not len(nodes):
            break
        order = np.argsort(-cap, kind="stable")
        now, rest = order[:OPENED], order[OPENED:]
        begin, count = first[nodes[now]].astype(np.int64), (last[nodes[now]] - first[nodes[now]]).astype(np.int64)
        kids = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        child = np.repeat(scores[now], count)
        fresh = np.ones(len(kids), bool)
        fresh[np.cumsum(count) - count] = False         # the first child is its parent's vector
        got = x[middle[kids[fresh]]] @ q
        taken += len(got)
        child[fresh] = got
        offer(middle[kids[fresh]], got)
        more_cap, more_least = bounds(kids, child)
        deep = last[kids] > first[kids]
        nodes, scores = np.append(nodes[rest], kids[deep]), np.append(scores[rest], child[deep])
        cap, least = np.append(cap[rest], more_cap[deep]), np.append(least[rest], more_least[deep])
    return best, taken


def _least(high: int) -> int:
    """The smallest whole score of LEAST_SHARE percent of ``high``."""
    return -(-LEAST_SHARE * high // 100)


def _cell(k: int, same: bool):
    def run(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(trees):
            t = trees.iloc[0]
            dim = int(t["dim"])
            x = np.frombuffer(t["vectors"], np.float64).reshape(int(t["n"]), dim)
            tree = {"ids": np.frombuffer(t["ids"], np.int64), "labels": np.frombuffer(t["labels"], np.int64), "top": float(t["top"]),
                    "radii": np.frombuffer(t["radii"], np.float64), "masks": np.frombuffer(t["masks"], np.int64),
                    **{c: np.frombuffer(t[c], np.int32) for c in ("middle", "first", "last")}}
            q = matrix(anchors["vector"], dim)
            kind = score_type(x, q)
            tree["x"], q = as_type(x, kind), as_type(q, kind)
            limit = float if kind is np.float64 else int
            for i, r in enumerate(anchors.itertuples()):
                lows = [limit(int(a) if same else max(int(a), _least(int(b)))) for a, b in zip(r.lows, r.highs)]
                highs = [limit(int(v)) for v in r.highs]
                found, _ = descend(tree, q[i], r.norm, r.label, same, r.anchor_id, lows, highs, k, kind)
                for hi, best in zip(r.highs, found):
                    out += [(r.anchor_id, hi, n, Decimal(max(-MOST, min(MOST, int(s))))) for s, n in best]
        return pd.DataFrame(out, columns=["anchor_id", "hi", "vec_id", "score"])
    return run


def _near(root: Column, vector: Column, norm: Column, top: Column, radius: Column) -> tuple[Column, Column]:
    """(cap, floor) of the inner products of a block, from its root."""
    score = F.aggregate(F.zip_with(root, vector, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    both = norm + top
    d, slack = F.sqrt(F.greatest(F.lit(0.0), both - 2 * score)), both * 1e-9 + 1
    gap = F.greatest(F.lit(0.0), d - radius)
    return (both - gap * gap) / 2 + slack, (both - (d + radius) * (d + radius)) / 2 - slack


def search(anchors: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, hi, vec_id, score, rank: the best ``k`` vectors of every window of every anchor, by score, then vec_id.

    ``anchors``: anchor_id, dim, centre, part (of its own block), label, norm, vector, numbers (its vector as array), and the
    arrays lows and highs of its windows, which hi names."""
    def visit(pairs: DataFrame) -> DataFrame:
        pairs = write_table(pairs, "visits")
        load = pairs.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / CELL_ANCHORS).alias("cells"))
        left = lookup_join(pairs, load, KEY).withColumn("cell", F.pmod(F.xxhash64("anchor_id"), F.col("cells")))
        right = trees.join(load, KEY).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        left = left.select(*KEY, "cell", "anchor_id", "label", "norm", "vector", "lows", "highs")
        right = right.drop("root", "radius", "mask", "cells")
        return write_table(left.groupBy(*KEY, "cell").cogroup(right.groupBy(*KEY, "cell")).applyInPandas(
            lambda a, t: _cell(k, same)(a, t), FOUND), "found")

    mine = visit(anchors)
    order = Window.partitionBy("anchor_id", "hi").orderBy(F.col("score").desc(), "vec_id")
    kth = mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).groupBy("anchor_id") \
        .agg(F.map_from_entries(F.collect_list(F.struct("hi", "score"))).alias("kth"))
    raised = F.transform(F.arrays_zip("lows", "highs"), lambda w: F.greatest(w["lows"], F.col("kth")[w["highs"]]))
    known = lookup_join(anchors, kth, ["anchor_id"], "left").withColumn("lows", F.coalesce(raised, "lows"))
    roots = trees.select(*KEY, "root", "radius", "top", "mask").withColumnsRenamed({"centre": "c", "part": "p"})
    pairs = known.join(roots, "dim").where("centre <> c or part <> p")      # each stated query against every block
    cap, least = _near(F.col("root"), F.col("numbers"), F.col("norm"), F.col("top"), F.col("radius"))
    bit = F.expr("shiftleft(1L, cast(pmod(label, 63) as int))")
    label = F.col("mask").bitwiseAND(bit) != 0 if same else \
        (F.col("mask").bitwiseAND(F.bitwise_not(bit)) != 0) | (F.col("mask") == bit)
    window = F.exists(F.arrays_zip("lows", "highs"), lambda w: ~((cap < w["lows"].cast("double")) | (least > w["highs"].cast("double"))))
    pairs = pairs.where(label & window).drop("centre", "part", "root", "radius", "top", "mask") \
        .withColumnsRenamed({"c": "centre", "p": "part"})
    found = mine.unionByName(visit(pairs))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the label of every seventh id moved on by one."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; components count as floor(256 * x).  Anchors are the rows
    whose vec_id is divisible by ``every``.  An anchor's positives are the best ``positives`` other rows
    of its label by inner product; for each, the negatives are the best ``negatives`` rows of other labels
    with 80 % of the positive's score to all of it.  Ties go to the smaller vec_id.  Only vectors of the
    anchor's length meet it.  Rows with a null id, label, vector or component or with a non-finite component
    take no part.  Of rows that repeat an anchor's id, the smallest (label, vector) is the anchor, and none is its
    positive; as candidates of other anchors, all count.  Scores beyond 64 bits stop at their limits.
    """
    rows = whole_vectors(vectors, "label")
    rows = write_table(blocks(write_table(rows, "whole-vectors"), BLOCK, "label"), "blocks")
    trees = write_table(rows.groupBy(*KEY).applyInPandas(_tree_row, TREE), "cover-trees")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id") \
        .agg(F.min(F.struct("label", "vector", "dim", "norm", "centre", "part")).alias("v")).select(F.col("vec_id").alias("anchor_id"), "v.*")
    numbers = F.pandas_udf(lambda v: v.map(lambda b: np.frombuffer(b, np.float64)), "array<double>")
    anchors = write_table(anchors.withColumn("numbers", numbers("vector")), "anchors")
    whole = F.array(F.lit(Decimal(MOST)))
    first = search(anchors.withColumn("lows", F.array(F.lit(Decimal(-MOST)))).withColumn("highs", whole),
                   trees, positives, True)
    first = write_table(first.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive")), "positives")
    # 80 * p <= 100 * n <= 100 * p has no solution below 0; the cells round the lower end exactly
    low = F.floor(F.col("positive").cast("double") * (LEAST_SHARE / 100 * (1 - 1e-9)) - 1).cast("decimal(38, 0)")
    windows = first.where("positive >= 0").select("anchor_id", "positive", low.alias("low")).distinct() \
        .groupBy("anchor_id").agg(F.collect_list(F.struct("positive", "low")).alias("w")) \
        .select("anchor_id", F.col("w.low").alias("lows"), F.col("w.positive").alias("highs"))
    second = search(lookup_join(anchors, windows, ["anchor_id"]), trees, negatives, False)
    out = first.join(second.withColumnRenamed("hi", "positive"), ["anchor_id", "positive"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                      as_long(F.col("positive")).alias("positive_score"), as_long(F.col("score")).alias("negative_score"))
