"""The corpus pipeline against brute force, stage by stage, and on odd rows."""

from __future__ import annotations

import math
import random
import tempfile

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tripleval.llm import mixing, near_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir):
    """Each stage's rows, written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        path = tempfile.mkdtemp(prefix="tripleval-stage-") + "/x"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).where("tox_predicted = 1").collect()}
    out = dict(stages(spark, docs, sf_dir))
    assert list(out) == [n for n, _ in corpus_pipeline.STAGES]
    assert all(df.columns == COLUMNS for n, df in out.items() if n != "best-fit packing")

    clean = out["toxicity"].collect()
    assert {r["doc_id"] for r in clean} == set(before) - toxic and len(clean) == len(before) - len(toxic)
    assert all(r == before[r["doc_id"]] for r in clean)

    lines = out["line dedup"].collect()
    want = brute.without_lines([(r["doc_id"], r["text"]) for r in clean])
    assert {r["doc_id"]: r["text"] for r in lines} == {i: x[2] for i, x in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    near = out["near dedup"].collect()
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in lines], percent=corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, x in groups.items() if x[2])

    mixed = out["source mix"].collect()
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in near}
    source = {r["doc_id"]: r["source"] for r in near}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target = brute.targets(sizes)
    assert {r["doc_id"] for r in mixed} <= set(size) and all(size[r["doc_id"]] for r in mixed)
    for s, t in target.items():
        taken = sum(size[r["doc_id"]] for r in mixed if r["source"] == s)
        longest = max(n for i, n in size.items() if source[i] == s)
        assert abs(taken - t) <= longest / 2 + mixing.BLOCK and taken <= 2 * sizes[s]

    packed = out["best-fit packing"].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed]
    assert sum(r["length"] for r in packed) == sum(lengths)
    assert len({r["sequence_id"] for r in packed}) <= math.ceil(sum(lengths) / 4096) + 1
    for r in packed:
        assert r["offset"] + r["length"] <= 4096


def test_run_gives_the_last_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *_, (_, last) = stages(spark, docs, sf_dir)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*cols).collect())) == sorted(map(tuple, last.select(*cols).collect()))


def test_odd_rows_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = "\n".join(f"line {k} of a passage that is repeated word for word" for k in range(6))
    rows = [(1, passage, "en", "a", len(passage)), (2, passage, None, None, None), (None, None, None, None, None), (3, "", "en", "b", 0),
            (4, "w " * 60_000, "en", "a", 120_000), (4, "w " * 60_000, "en", "a", 120_000), (None, passage, "en", "b", None)]
    out = dict(stages(spark, spark.createDataFrame(rows, schema), sf_dir))
    assert out["toxicity"].count() == out["line dedup"].count() == len(rows)
    assert out["best-fit packing"].count() >= 2
    for _, df in stages(spark, spark.createDataFrame([], schema), sf_dir):
        assert df.count() == 0


def test_near_stage_takes_pairs_from_080(spark, sf_dir):
    """Copies with two of 100 words changed (similarity 0.81), and with three (0.73), which stay."""
    rng, rows = random.Random(20), []
    for k in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        copy = list(base)
        for at in (20, 60) if k % 4 else (20, 50, 80):
            copy[at + rng.randrange(10)] = f"changed{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    want = {i for i, x in brute.near_groups(rows, percent=80).items() if x[2]}
    assert len(want) == 50 and len([x for x in brute.near_groups(rows).values() if x[2]]) == 80
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_near(spark, docs, sf_dir)
    assert out.columns == COLUMNS and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_bands_by_threshold():
    for percent in (80, 82, 85, 90):
        bands, rows = near_dedup.layout(percent)
        assert bands * rows <= near_dedup.HASHES and (1 - (percent / 100) ** rows) ** bands < 4e-6


def test_near_stage_tells_rows_apart(spark, sf_dir):
    """Unrelated texts under one id, rows repeated whole, and null ids."""
    texts = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abcde"}
    near_e = texts["e"] + " more"
    rows = [(5, texts["a"], "en"), (7, texts["a"], "en"), (7, texts["b"], "en"), (9, texts["c"], "en"), (9, texts["c"], "en"),
            (9, texts["c"], "de"), (None, texts["c"], "en"), (None, texts["d"], "en"), (None, texts["d"], "en"), (None, texts["e"], "en"),
            (11, near_e, "en"), (12, "", "en"), (13, None, "en"), (None, None, "en"), (-1, texts["b"] + " more", "en")]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_near(spark, docs, sf_dir)
    assert out.columns == COLUMNS and out.dtypes == docs.dtypes
    want = [(5, texts["a"], "en"), (-1, texts["b"] + " more", "en"), (9, texts["c"], "de"), (None, texts["d"], "en"), (11, near_e, "en"),
            (12, "", "en"), (13, None, "en"), (None, None, "en")]
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == sorted(want, key=str)
    # an unrelated text under a repeated id stays when its namesake goes
    out = corpus_pipeline.dedup_near(spark, docs.where("doc_id in (5, 7)"), sf_dir)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(5, texts["a"]), (7, texts["b"])]
