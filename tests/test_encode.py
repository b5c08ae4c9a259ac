import random

import pytest
from pyspark.sql import functions as F

from tripleval.operators import encode, joins


@pytest.mark.parametrize("p,a,kept", [(5, 3, 5), (600, 100, 412), (1000, 10, 502), (2000, 10, 502), (10, 600, 0)])
def test_mask_labels_cases(spark, p, a, kept):
    prompt = list(range(1000, 1000 + p))
    answer = list(range(5000, 5000 + a))
    df = spark.createDataFrame([(1, prompt, answer)], "example_id long, prompt_ids array<int>, answer_ids array<int>")
    r = encode.mask_labels(df, 512).first()
    ids = (prompt + answer)[-512:]
    assert list(r.input_ids) == ids
    assert r.kept_prompt == kept
    labels = list(r.labels)
    assert len(labels) == len(ids) == len(r.attention_mask)
    # -100 exactly on the kept prompt positions, ids on answer positions
    assert labels == [-100] * kept + ids[kept:]
    assert all(t >= 5000 for t in ids[kept:])


def test_pad_batches_shapes(spark):
    rows = [(i, list(range(i % 7 + 1)), list(range(i % 3))) for i in range(20)]
    df = spark.createDataFrame(rows, "example_id long, prompt_ids array<int>, answer_ids array<int>")
    out = encode.pad_batches(encode.mask_labels(df, 512), batch_size=8).collect()
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch_id, []).append(r)
    assert sorted(by_batch) == [0, 1, 2]
    for rs in by_batch.values():
        n = {len(r.input_ids) for r in rs} | {len(r.labels) for r in rs} | {len(r.attention_mask) for r in rs}
        assert len(n) == 1
        for r in rs:
            real = sum(r.attention_mask)
            assert all(x == 0 for x in r.input_ids[real:]) and all(x == -100 for x in r.labels[real:])


def test_vocab_and_encode(spark):
    ex = spark.createDataFrame([(1, "b a b", "c"), (2, "a b", "zz")], "example_id long, prompt string, response string")
    vocab = {r.token: r.token_id for r in encode.build_vocab(ex).collect()}
    assert vocab == {"b": 3, "a": 4, "c": 5, "zz": 6}  # count desc, token asc, after reserved 0..2
    enc = {r.example_id: (list(r.prompt_ids), list(r.answer_ids))
           for r in encode.encode_examples(ex, encode.build_vocab(ex, max_size=2)).collect()}
    assert enc == {1: ([3, 4, 3], [2]), 2: ([4, 3], [2])}


def test_truncate_inference_prompt(spark):
    df = spark.createDataFrame([(list(range(10)),)], "ids array<int>")
    r = df.select(encode.truncate_inference_prompt(F.col("ids"), 4, "tail").alias("t"),
                  encode.truncate_inference_prompt(F.col("ids"), 4, "head").alias("h")).first()
    assert list(r.t) == [6, 7, 8, 9] and list(r.h) == [0, 1, 2, 3]


def test_only_rare_tokens_are_written_and_shuffled(spark, monkeypatch):
    """Beyond the broadcast limit the frequent tokens meet their ids where they are."""
    ex = spark.createDataFrame([(i, "the of and " * 20 + f"rare{i}", "the") for i in range(40)] + [(40, "", ""), (41, "the", None)],
                               "example_id long, prompt string, response string")
    vocab = encode.build_vocab(ex)
    written = []
    real = joins.write_table

    def noted(df, name, partition_by=None):
        out = real(df, name, partition_by)
        written.append(out.count())
        return out

    monkeypatch.setattr(joins, "write_table", noted)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 600)     # a few rows of the vocabulary
    got = {r.example_id: (list(r.prompt_ids), list(r.answer_ids)) for r in encode.encode_examples(ex, vocab).collect()}
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert got == {i: ([ids["the"], ids["of"], ids["and"]] * 20 + [ids[f"rare{i}"]], [ids["the"]]) for i in range(40)} | {40: ([], [])}
    assert written == [41]      # one rare token of each example, and the example without tokens


def test_examples_of_one_key_are_merged_by_place(spark):
    ex = spark.createDataFrame([(1, "b a", "b"), (1, "b a", "b"), (2, "a b", ""), (2, "b", "a")],
                               "example_id long, prompt string, response string").repartition(3)
    vocab = encode.build_vocab(ex)
    a, b = ({r.token: r.token_id for r in vocab.collect()}[t] for t in "ab")
    got = {r.example_id: (list(r.prompt_ids), list(r.answer_ids)) for r in encode.encode_examples(ex, vocab).collect()}
    assert got == {1: ([b, b, a, a], [b, b]), 2: (sorted([a, b]) + [b], [a])}


@pytest.mark.parametrize("limit", [None, 0, 400])
def test_rare_words_fill_the_gaps_of_their_rows(spark, monkeypatch, limit):
    """Beyond the broadcast limit a row keeps its frequent ids as one array, and a rare word comes back as one long."""
    rnd = random.Random(11)
    def text(n):
        return " ".join(rnd.choice(["the", "of", "and", f"r{rnd.randrange(60)}", f"u{rnd.randrange(10**6)}"]) for _ in range(n))
    rows = [(i, text(rnd.randrange(12)), text(rnd.randrange(5))) for i in range(40)] + [(50, text(300), ""), (51, "", text(90)), (None, "the r1", "of")]
    rows += [(i, "r3 the", "zz the") for i in (60, 60)]       # one key twice: merged by place
    ex = spark.createDataFrame(rows, "example_id long, prompt string, response string")
    vocab = encode.build_vocab(ex.where("example_id < 45 OR example_id = 60"))
    ids = {r.token: r.token_id for r in vocab.collect()}
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    runs = []
    real = encode.runs_of
    monkeypatch.setattr(encode, "runs_of", lambda *a: runs.append(real(*a)) or runs[-1])
    def coded(s):
        return [ids.get(w, encode.UNK_ID) for w in s.split()]
    want = sorted([(i, coded(p), coded(r)) for i, p, r in rows if i != 60] + [(60, [x for x in coded("r3 the") for _ in "ab"], [x for x in coded("zz the") for _ in "ab"])], key=str)
    got = encode.encode_examples(ex, vocab).collect()
    assert sorted([(r.example_id, list(r.prompt_ids), list(r.answer_ids)) for r in got], key=str) == want
    # at most one array of a prompt and one of a response, whatever rare words are between
    assert runs[0].count() <= 2 * len(rows)


def test_padded_rows_stay_where_they_were_numbered(spark):
    """No window over the batches: their lengths alone are shuffled."""
    masked = spark.createDataFrame([(i, list(range(i % 5 + 1)), [1] * (i % 5 + 1), [-100] * (i % 5 + 1)) for i in range(50)],
                                   "example_id long, input_ids array<int>, attention_mask array<int>, labels array<int>")
    out = encode.pad_batches(masked, 4)
    assert "windowspecdefinition(batch_id" not in out._jdf.queryExecution().analyzed().toString()
    got = out.orderBy("example_id").collect()
    for k in range(0, 50, 4):
        longest = max(i % 5 + 1 for i in range(k, min(k + 4, 50)))
        assert {len(r.input_ids) for r in got[k:k + 4]} == {len(r.labels) for r in got[k:k + 4]} == {longest}
