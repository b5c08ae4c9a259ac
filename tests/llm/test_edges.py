"""Defined results of every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripleval.llm import (chat, components, fingerprints, line_dedup, mixing, near_dedup, packing, secrets, substring_dedup, top_k,
                           toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, mark long, size long, _row string, "
          "_id string, tox_score string, n_lines string, n_removed string, _key string, score string, spans string, words string")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]


LONG = " ".join(words(1, 30_000))
PASSAGE = " ".join(words(2, 60))
LINES = "\n".join(" ".join(words(k, 8)) for k in range(10, 16))

DOCS = [
    (1, PASSAGE), (2, "x " + PASSAGE + " y"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (8, LINES), (9, LINES + "\nend"),
    (10, "a"), (11, "A"), (12, "one two three four"), (13, "One Two THREE four"), (14, "é É ß 漢字 🙂 \x1c z"),
    (15, "w " * 50), (16, "\n\n\n\n"), (17, "l\nl\nl\nl\nl"), (18, PASSAGE[:len(PASSAGE) // 2]), (-5, PASSAGE), (20, LONG[:100_000]),
]


def frame(spark, rows):
    full = [(i, t, "en", None if i is not None and i % 3 == 0 else f"s{(i or 0) % 4}", None if t is None else len(t), *["clash"] * 12)
            for i, t in rows]
    full = [(*r[:5], r[5], 7, 7, *r[8:]) for r in full]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, rows repeated whole, and one id with two texts."""
    return frame(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (2, LINES), (None, PASSAGE), (None, None), (None, LINES), (3, LINES)]).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_near_duplicates(docs, odd, nothing):
    got = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == brute.near_groups(DOCS)
    rows = near_dedup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 3
    assert near_dedup.near_duplicates(nothing).collect() == []
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in brute.near_groups(DOCS).items() if x[2]}


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", 900)
    base, rng, rows = words(3, 120), random.Random(4), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = by_id(near_dedup.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept")
    assert got == brute.near_groups(rows)


def test_similarity_estimate():
    rng = np.random.default_rng(0)
    xor, odd_ = near_dedup._parameters()
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    x, y = (np.frombuffer(near_dedup.pack_low_bits(near_dedup.minima(s, xor, odd_)), np.uint64) for s in (a, b))
    assert abs(near_dedup.similarity(x, y) - 1 / 3) < 0.15
    assert near_dedup.similarity(x, x) == 1


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_components(spark, monkeypatch, broadcast):
    monkeypatch.setattr(components, "BROADCAST_BYTES", broadcast)
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).collect() == []


def test_substrings(docs, odd, nothing):
    got = by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept")
    assert got == brute.without_repeats(DOCS)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"], r["n_words"]) for r in substring_dedup.remove_repeats(odd).collect()))
    # null ids come first; equal id and text are one document
    assert [x[:3] for x in rows if not x[0]] == [(False, 0, 0)] * 3
    assert [x[2] for x in rows if x[0]] == [60, 60, 48, 60, 48]
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_substrings_with_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(substring_dedup, "STEP_BYTES", 4000)
    rng, rows = random.Random(5), []
    for i in range(150):
        own = words(1000 + i, rng.randint(0, 40))
        at = rng.randint(0, len(own))
        rows.append((i, " ".join(own[:at] + PASSAGE.split()[rng.randint(0, 20):rng.randint(25, 60)] + own[at:])))
    rows += [(200 + k, "ab " * (30 + k)) for k in range(6)]
    got = by_id(substring_dedup.remove_repeats(frame(spark, rows), hot_share=1e-3), "n_words", "n_removed", "kept")
    assert got == brute.without_repeats(rows)


def test_lines(docs, odd, nothing):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    want = brute.without_lines(DOCS)
    got = by_id(out, "n_lines", "n_removed", "text")
    assert got.pop(3) == (0, 0, None)
    want.pop(3)
    assert got == want
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.drop_repeated_lines(odd).collect())
    assert rows == [(False, 0, 0), (False, 0, 0), (False, 0, 0), (True, 1, 0), (True, 1, 0), (True, 2, 0), (True, 2, 6), (True, 3, 6)]
    assert line_dedup.drop_repeated_lines(nothing).collect() == []


def test_packing(spark, docs, odd, nothing):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(packing.token_pieces(docs, TOKENIZER)).collect()
    want = set()
    for i, text in DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want.add((i, p, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert packing.pack(packing.token_pieces(odd, TOKENIZER)).count() == odd.count()
    assert packing.pack(packing.token_pieces(nothing, TOKENIZER)).collect() == []


def test_packing_in_many_groups(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, 0, 0, rng.choice([3000, 1100, 900, 700, 2049, 60]), i) for i in range(3000)], packing.PIECES)
    rows = packing.pack(items, group_items=300).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    fill = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 4096)
    assert bound <= len(fill) <= bound * 1.03 + 1


def test_packing_goes_on_while_it_gains(spark, monkeypatch):
    """Lengths that leave few bins full: rounds end with one group, or with one that gains nothing."""
    rounds, write = [], packing.write_table

    def seen(df, name):
        rounds.append(write(df, name))
        return rounds[-1]

    monkeypatch.setattr(packing, "write_table", seen)
    rng = random.Random(11)
    items = spark.createDataFrame([(i, 0, 0, rng.randrange(30, 45), i) for i in range(900)], packing.PIECES).cache()
    rows = packing.pack(items, capacity=100, group_items=30).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    fill = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 100
    state = [(len(x), len({r["sequence_id"] for r in x})) for x in ([r for r in t.collect() if r["open"]] for t in rounds)]
    all_rows = [t.count() for t in rounds]
    assert len(rounds) > 6 and (all_rows[-1] <= 30 or (state[-1][0] == state[-2][0] and state[-1][1] >= state[-2][1]))


def test_lower_bound_holds_and_sees_halves():
    assert packing.lower_bound(np.array([2049] * 10), 4096) == 10
    assert packing.lower_bound(np.array([1366] * 9), 4096) == 5      # two of them fit, not three
    assert packing.lower_bound(np.array([], np.int64), 4096) == 0
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = np.sort(rng.integers(1, 4097, 80))[::-1]
        assert packing.lower_bound(x, 4096) <= len(packing.best_fit_decreasing(x, 4096)[2])


def test_mix(spark, docs, odd, nothing):
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len((t or "").encode().split()) for i, t in DOCS}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute.targets(sizes)
    for r in got:
        assert (r["source"], r["size"], r["source_size"]) == (source[r["doc_id"]], size[r["doc_id"]], sizes[r["source"]])
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= mixing.BLOCK
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(nothing).collect() == [] and mixing.mix_documents(nothing).collect() == []
    whole = mixing.mix_documents(docs)
    assert whole.columns == docs.columns
    assert all(r["text"] in {t for _, t in DOCS} for r in whole.collect())
    assert mixing.mix(docs.where("doc_id in (3, 4)")).select("taken").collect() == [(0,), (0,)]


def test_mix_in_many_shards(docs):
    got = mixing.mix(docs, shard_words=500).collect()
    target = {r["source"]: r["target"] for r in got}
    for s, t in target.items():
        shards = len({r["shard"] for r in got if r["source"] == s})
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= mixing.BLOCK * shards


def test_apportion(spark):
    from pyspark.sql import functions as F
    rng = random.Random(7)
    for n in (0, 1, 13, 500):
        votes = {f"k{j:02}": float(rng.choice([0, 1, 3, 50, 50, 1000])) for j in range(25)}
        df = spark.createDataFrame(list(votes.items()), "k string, v double")
        got = {r["k"]: r["seats"] for r in mixing.apportion(df, "v", F.lit(n), []).collect()}
        assert got == brute.seats(votes, n)


def test_secrets(spark, docs, odd, nothing):
    rng = random.Random(8)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    rows = [(1, "token: token:abcdefg 🙂 SECRET='x1y2z3'"), (2, "AKIA" + "Q1" * 8 + " AKIAQ1 " + "f0" * 12 + "é" + "a" * 24), (3, None), (4, ""),
            (5, f"é look {key} there"), (6, "internationalizationconfiguration " * 3), (7, "api-key apikey=abcdef, API_KEY : \"abcdefg\""),
            (8, "passwd=" + "z" * 100_000), (9, "0" * 30)]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan(frame(spark, rows)).collect()}
    for i, text in rows:
        assert [s for s in got[i] if s[1] < 3] == brute.base_spans(text)
    assert (7, 3, 71) in got[5] and not any(s[1] == 3 for s in got[6])
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(nothing).collect() == []
    assert secrets.scan(docs).count() == len(DOCS)


def test_secrets_in_runs_of_no_encoding(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    plain, slashed, short = draw(64), draw(30) + "/" + draw(33), "+".join(draw(9) + "_" + draw(9) for _ in range(4))
    texts = [f"at my_repo/ghp_{plain} end", f"at sk_live_{slashed} end", f"at {short} end"]
    docs = frame(spark, [*enumerate(texts), (3, "a/long_path/of-plain_words/in-a_tree/of-many_folders/and-other_files")])
    found = {r["doc_id"]: r["tokens"] for r in docs.select("doc_id", secrets.random_tokens(docs["text"]).alias("tokens")).collect()}
    assert all(t is not None for x in found.values() for t in x) and all(found[i] for i in range(4))
    got = {r["doc_id"]: {texts[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"]} for r in secrets.scan(docs).collect() if r["doc_id"] < 3}
    assert plain in got[0] and slashed in got[1] and got[2] == {short}
    assert not {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}[3]


def test_fingerprints(spark, docs, odd, nothing):
    from pyspark.sql import functions as F
    own = docs.select("doc_id", "text", fingerprints.fingerprint(F.col("text")).alias("m")).withColumn(
        "like", fingerprints.likeness(F.col("m"), F.col("m")))
    rows = {r["doc_id"]: r for r in own.collect()}
    assert all(r["like"] == 1.0 for r in rows.values())
    assert rows[3]["m"] == rows[4]["m"] == rows[5]["m"] == [] and rows[6]["m"] == rows[7]["m"]
    assert len(rows[10]["m"]) == fingerprints.BINS * fingerprints.BITS // 64
    pair = spark.createDataFrame([(PASSAGE, "")], "a string, b string").select(
        fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))))
    assert pair.first()[0] == 0.0
    nxt = by_id(fingerprints.with_next(docs.select("doc_id", "text"), ["text"]), "next_text")
    down = sorted(DOCS, key=lambda r: -r[0])
    assert nxt == {i: (down[(k + 1) % len(down)][1],) for k, (i, _) in enumerate(down)}
    rows = fingerprints.with_next(odd.select("doc_id", "text"), ["text"]).collect()
    assert len(rows) == 8 and all(r["next_text"] is None for r in rows if r["doc_id"] is None)
    assert fingerprints.with_next(nothing.select("doc_id", "text"), ["text"]).collect() == []


def test_next_documents_over_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SINGLE_TASK_BLOCKS", 3)
    rng = random.Random(9)
    ids = sorted({rng.randrange(-(1 << 40), 1 << 40) for _ in range(60)} | set(range(2000, 2100)), reverse=True)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = by_id(fingerprints.with_next(df, ["text"]), "next_text")
    assert got == {i: (f"t{ids[(k + 1) % len(ids)]}",) for k, i in enumerate(ids)}


def test_chat(spark):
    from pyspark.sql import functions as F
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[TURN]", "a\n[NEXT]", "[/TURN]\n[TURN]user\n[TEXT]", "\n", "", None, "\\[TEXT]\\", "<s", "é🙂[TEXT]"]
    rows = [(1, k, "user" if k % 3 else "assistant", t, "clash") for k, t in enumerate(nasty)]
    rows += [(2, 0, "[TURN]\\", "x", "c"), (2, 0, "[TURN]\\", "x", "c"), (2, None, None, None, "c"), (3, 1, "assistant", "b", "c"), (3, 0, "assistant", "a", "c"),
             (None, 0, "user", "u", "c"), (4, 0, "assistant", LONG, "c")] + [(5, k, "assistant", f"t{k}", "c") for k in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(turns).withColumn("back", chat.read_turns(F.col("formatted"))) \
        .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    want = brute.conversations([r[:4] for r in rows])
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for conv, (said, loss) in want.items():
        assert [tuple(t) for t in got[conv]["back"]] == said and got[conv]["loss"] == loss and got[conv]["n_turns"] == len(said)
    assert got[3]["formatted"] == "[TURN]assistant\n[TEXT]a\n[NEXT]b\n[/TURN]\n"     # one merged block
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(-100, 120)]
    rows += [(200, [1.0, 1.0, 1.0, 1.0]), (201, [1.0, 1.0, 1.0, 1.0]), (202, None), (250, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4),
             (300, [float("inf")] * 4), (350, [1.0, 2.0]), (351, [3.0, 4.0]), (None, [1.0] * 4), (400, []), (450, [1e9, 2e9, -3e9, 1.0])]
    schema = "vec_id long, embedding array<float>, score string"
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    vec = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in vec if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.exact_top_k(df).collect()}
    assert got == want
    assert top_k.exact_top_k(df.limit(0)).collect() == []


def test_top_k_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 60)
    monkeypatch.setattr(top_k, "CELL_QUERIES", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 3, (400, 3))
    df = spark.createDataFrame([(i, [float(a) for a in v / 256]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.exact_top_k(df).collect()}
    for q in range(0, 400, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_top_k_of_components_of_any_size(spark):
    rows = [(50, [1e30, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 0.0]), (100, [-1e15, 3.0]), (3, [1e15, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vec = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {}
    for q in (50, 100):
        best = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)[:5]
        want |= {(q, k + 1): (i, clip(-s)) for k, (s, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.exact_top_k(df).collect()} == want


def test_pivots_exclude(spark):
    """On vectors without clusters, most candidates are excluded by their caps."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    work = top_k.search_work(df).first()
    assert work["scores"] == 40 * 1999 and work["scores_taken"] < 0.2 * work["scores"]


def test_caps_hold():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(300, 12)))
    norm = (x * x).sum(axis=1)
    for most in (1, 5, 12):
        p = top_k.spread(x[:40], most)
        assert len(p) == most
        y = top_k.coordinates(top_k.distances(x, norm, p), norm, p)
        assert (y @ y.T + top_k._slack(norm[:, None], norm.max()) >= x @ x.T).all()
    assert len(top_k.spread(np.repeat(x[:2], 5, axis=0), 5)) == 2
    assert len(top_k.spread(np.zeros((4, 3)), 2)) == 0


def test_toxicity(spark, docs, odd, nothing):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        w = words(20_000 + i, 60)
        for _ in range(3 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["grumbolex", "Fnarkly!", "zibbersnork"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if bad else 0))
    teach = spark.createDataFrame([*labels, (1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    out = toxicity.score(frame(spark, rows), teach)
    got = out.select("doc_id", "tox_held_out", "tox_score", "tox_predicted").collect()
    held = [r for r in got if r["tox_held_out"]]
    assert len(got) == 1500 and all(r["tox_held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["tox_predicted"] == (r["doc_id"] % 4 == 0) for r in held) > 0.95 * len(held)
    kept = toxicity.drop_toxic(frame(spark, rows), teach)
    assert kept.columns == nothing.columns and 1050 < kept.count() < 1200
    # no usable labels, one class only, odd rows, nothing at all
    assert {r["tox_score"] for r in toxicity.score(docs, teach.limit(0)).collect()} == {0.0}
    assert toxicity.score(odd, teach).count() == odd.count()
    assert toxicity.score(nothing, teach).collect() == []


def test_text_features_of_plain_cases():
    import pyarrow as pa
    x = toxicity.text_features(pa.array(["", "you are a M0R0N, idiot!", "HELLO THERE", "a"]), toxicity.WordFeatures({}))
    name = {n: k for k, n in enumerate(toxicity.FEATURES)}
    assert not x[0].any()
    assert x[1][name["seed_density"]] == pytest.approx(1 / 5) and x[1][name["near_you_density"]] > 0
    assert x[1][name["hidden_density"]] == pytest.approx(1 / 5)
    assert x[2][name["shout_rate"]] == 1 and x[3][name["shout_rate"]] == 0


def test_stages_keep_columns_of_any_name_and_type(spark):
    """Columns named like the operators' own, and a map, which has no order."""
    names = ["tox_raw", "tox_p", "tox_vector", "tox_probability", "tox_class", "tox_score", "tox_held_out", "tox_predicted", "_toxic", "_part",
             "row", "rank", "n", "id", "a", "b", "one", "component_id", "kept"]
    rows = [(i, t, f"clash {i}", {"k": str(i)}) for i, t in [*DOCS, (1, PASSAGE), (None, PASSAGE), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, clash string, extra map<string,string>") \
        .select("doc_id", "text", "extra", *(F.col("clash").alias(c) for c in names))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 15)], "doc_id long, toxic int")
    for out in (toxicity.drop_toxic(docs, labels), near_dedup.drop_near_duplicates(docs), near_dedup.drop_near_duplicates(docs.where("doc_id > 1"))):
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert got and all(r["tox_score"] == r["kept"] == f"clash {r['doc_id']}" and r["extra"] == {"k": str(r["doc_id"])} for r in got)
    scored = toxicity.score(docs, labels)
    assert scored.columns == [c for c in docs.columns if c not in ("tox_score", "tox_held_out", "tox_predicted")] + [
        "tox_held_out", "tox_score", "tox_predicted"]
    assert scored.count() == len(rows) and all(r["tox_raw"] == f"clash {r['doc_id']}" for r in scored.collect())
