"""Jaccard join, collocations and hard negatives against brute force, and their results on odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.test_edges import DOCS, LONG, PASSAGE, by_id, frame, words
from tripleval.llm import collocations, hard_negatives, jaccard_join
from tripleval.llm.shingles import shingle_sets

JOINED = ("n_shingles", "component_id", "n_links")


def test_jaccard_groups(spark):
    got = by_id(jaccard_join.jaccard_groups(frame(spark, DOCS).repartition(3)), *JOINED)
    assert got == brute.jaccard_groups(DOCS)
    assert jaccard_join.jaccard_groups(frame(spark, [])).collect() == []


def test_jaccard_groups_of_odd_rows(spark):
    odd = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (2, LONG), (None, PASSAGE), (None, None), (3, LONG)]
    rows = jaccard_join.jaccard_groups(frame(spark, odd)).collect()
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in rows if r["doc_id"] is not None)
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (2, 2, 1), (3, 2, 1)]
    assert [(r["component_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, 0)] * 2


def near_copies(seed: int, n: int, length: int, changes: int) -> list[tuple[int, str]]:
    base, rng, rows = words(seed, length), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot", [3, 100])
def test_jaccard_groups_in_many_blocks(spark, monkeypatch, hot):
    """A group of near copies, a passage that unrelated documents share, and short texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 9)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = near_copies(3, 90, 120, 6)
    rows += [(100 + k, " ".join(words(500 + k, 60)) + " " + PASSAGE) for k in range(30)]
    rows += [(200 + k, " ".join(words(900 + k % 7, 3 + k % 9))) for k in range(40)]
    got = by_id(jaccard_join.jaccard_groups(frame(spark, rows)), *JOINED)
    assert got == brute.jaccard_groups(rows)


def test_trie_finds_all_pairs():
    texts = [t for _, t in near_copies(8, 60, 80, 5)] + [" ".join(words(70 + k, 40)) for k in range(20)]
    sets = list(shingle_sets(pa.array(sorted(set(texts))), 3))
    trie = jaccard_join.Trie(sets)
    got = {tuple(sorted((trie.order[at], trie.order[k]))) for at, found in trie.probe(np.arange(len(sets)), 90)
           for k in found.tolist() if k != at}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert got == want and want


def test_blocks_and_earlier_homes_count_each_pair_once():
    sets = list(shingle_sets(pa.array(sorted({t for _, t in near_copies(9, 30, 100, 3)})), 3))
    n = len(sets)
    ones, none = np.ones(n, np.int64), [frozenset()] * n
    whole, _ = jaccard_join.linked(sets, np.ones(n, bool), None, ones, none, 90)
    block = np.arange(n) % 2
    parts = np.zeros(n, np.int64)
    for b in (0, 1):
        at = np.flatnonzero(block == b)
        parts[at] += jaccard_join.linked([sets[k] for k in at], np.ones(len(at), bool), None, ones[at], none, 90)[0]
    parts += jaccard_join.linked(sets, np.ones(n, bool), block, ones, none, 90)[0]
    assert (parts == whole).all() and whole.sum()
    met = np.arange(n) < 10
    earlier = [frozenset([1]) if k < 10 else frozenset() for k in range(n)]
    first, _ = jaccard_join.linked([sets[k] for k in range(10)], np.ones(10, bool), None, ones[:10], none[:10], 90)
    rest, _ = jaccard_join.linked(sets, ~met, None, ones, earlier, 90)
    rest[:10] += first
    assert (rest == whole).all()


def phrase_rows(seed: int) -> list[tuple[str | None, str | None]]:
    rng, rows = random.Random(seed), [("en", None), ("en", ""), (None, ". , ;"), ("xx", "one"), ("en", "\t \n")]
    for k in range(260):
        w = [rng.choice(["New", "york", "city", "of", "é", "漢字", "a\x1cb", "the", "The"]) for _ in range(rng.randint(1, 30))]
        w += ["New", "York", "city", "Hall"] if k % 2 else ["tea", "tea", "tea", "tea", "tea"]
        sep = [rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ? ", "\x0b"]) if rng.random() < 0.2 else " " for _ in w]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(a + b for a, b in zip(w, sep))))
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(k, lang, t, "clash", 7, "clash", 1) for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, f long, size string, text_hash long")


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    rows = phrase_rows(1)
    out = collocations.collocations(table_of(spark, rows).repartition(3), top=top)
    assert out.columns == COLUMNS
    assert {tuple(r) for r in out.collect()} == brute.collocations(rows, top=top)
    assert collocations.collocations(table_of(spark, rows).limit(0)).collect() == []


def test_collocations_with_long_texts_and_repeated_rows(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdef") for _ in range(60_000))
    rows = [("en", long), ("en", long), ("de", long), ("de", "a b c")] + [("fr", "le chat")] * 40
    out = collocations.collocations(table_of(spark, rows))
    got = {tuple(r) for r in out.where("lang = 'fr'").collect()}
    assert got == {("fr", 1, "le chat", 40, 40, 40, 80, 1_000_000)}
    en = {r["phrase"]: r["a"] for r in out.where("lang = 'en'").collect()}
    w = long.split()
    assert en["a b"] == 2 * sum(x == ("a", "b") for x in zip(w, w[1:]))


def test_colliding_fingerprints_are_told_apart(spark):
    """With fingerprints of nine bits nearly every one holds several phrases."""
    rows = phrase_rows(2)
    whole = {tuple(r) for r in collocations.phrase_counts(table_of(spark, rows)).collect()}
    got = {tuple(r) for r in collocations.phrase_counts(table_of(spark, rows), fp_bits=9).collect()}
    assert got == whole and len(whole) > 60


def test_tally_with_collisions():
    fp, proof = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 3, 1, 3], np.uint32)
    at, times = collocations.tally(fp, proof)
    assert sorted((int(fp[a]), int(proof[a]), int(n)) for a, n in zip(at, times)) == [(5, 1, 2), (5, 2, 1), (7, 3, 2)]


SCHEMA = "vec_id long, embedding array<double>, label int, score string, anchor_id string, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 4))) for i in range(-200, 400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(150)]                      # one vector many times
    rows += [(2000, None, 1), (2100, [1.0, None, 1.0, 1.0], 1), (2200, [float("nan")] * 4, 1), (2300, [float("inf")] * 4, 1),
             (2400, [1.0] * 4, None), (None, [1.0] * 4, 1), (2500, [], 1), (2600, [1.0, 2.0], 1), (2601, [2.0, 1.0], 2), (2602, [1.0, 2.0], 1),
             (2603, [1.0, 2.0], -5), (2700, [1e9, 2e9, -3e9, 1.0], 1), (2800, [0.0] * 4, 1)]
    got = {tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()}
    assert got == brute.hard_negatives(rows)
    assert hard_negatives.hard_negatives(vectors(spark, [])).collect() == []


def test_hard_negatives_of_any_size(spark):
    """Components whose products pass 64 bits; an id that repeats."""
    rows = [(0, [1e15, 1.0], 1), (1, [1e15, 2.0], 1), (2, [1e15, -1.0], 2), (3, [9.5e14, 0.0], 2), (4, [1.1e15, 0.0], 3), (5, [-1e15, 0.0], 3)]
    got = {tuple(r)[:4] for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()}
    assert got == {x[:4] for x in brute.hard_negatives(rows)}
    twice = [(0, [1.0, 0.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 0.0], 2)]
    got = {tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, twice)).collect()}
    assert got == {(0, 1, 1, 2, 256 * 256, 230 * 256)}


def test_cover_tree_covers():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 5)), rng.normal(size=(300, 5)) * 0.01 + 3, np.zeros((100, 5))])
    middle, radius, first, last = hard_negatives.cover_tree(x)
    below = [None] * len(middle)
    for k in range(len(middle) - 1, -1, -1):
        below[k] = [middle[k]] if first[k] == last[k] else [r for c in range(first[k], last[k]) for r in below[c]]
        assert np.sqrt(((x[below[k]] - x[middle[k]]) ** 2).sum(axis=1)).max() <= radius[k] + 1e-9
        assert first[k] == last[k] or middle[first[k]] == middle[k]
    assert sorted(below[0]) == list(range(len(x)))


def test_search_leaves_out_far_nodes():
    """Clustered vectors: the descent takes a small share of the scores."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)), 100, axis=0) + rng.normal(size=(4000, 8)) * 0.02))
    norm = (x * x).sum(axis=1)
    middle, radii, first, last = hard_negatives.cover_tree(np.column_stack([x, np.sqrt(norm.max() - norm)]))
    labels = np.arange(4000) % 3
    masks = (np.int64(1) << labels)[middle]
    for k in range(len(middle) - 1, -1, -1):
        for c in range(first[k], last[k]):
            masks[k] |= masks[c]
    tree = {"x": x, "ids": np.arange(4000), "labels": labels, "top": norm.max(), "middle": middle, "radii": radii, "masks": masks,
            "first": first, "last": last}
    taken = 0
    for q in range(0, 4000, 100):
        (best,), n = hard_negatives.descend(tree, x[q], norm[q], int(labels[q]), True, q, [float("-inf")], [float("inf")], 5, np.float64)
        s = x @ x[q]
        want = sorted((j for j in range(4000) if labels[j] == labels[q] and j != q), key=lambda j: (-s[j], j))[:5]
        assert [j for _, j in best] == want
        taken += n
    assert taken < 0.3 * 40 * 4000
