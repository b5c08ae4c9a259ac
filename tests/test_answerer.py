import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tripleval.operators import encode, joins, retrieve


def _tokens(s):
    return re.findall(r"[a-z0-9]+", s.lower())


def _brute(train, val):
    toks = {tid: set(_tokens(o)) for tid, o, _ in train}
    df = Counter(t for s in toks.values() for t in s)
    answers = {tid: a for tid, _, a in train}
    out = {}
    for dist, vid, obs in val:
        q = set(_tokens(obs))
        scores = {tid: sum(10**9 // df[t] for t in q & s) * 1000 // len(s) for tid, s in toks.items() if q & s}
        if scores:
            best = min(scores, key=lambda k: (-scores[k], k))
            out[(dist, vid)] = (best, scores[best], answers[best])
    return out


def _fixture(seed=5, n_train=60, n_val=25):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    def doc():   # "the" and "of" on every row: hot keys for the token joins
        return "The of " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 12)))
    train = [(i, doc(), f"answer {i % 17}") for i in range(n_train)]
    val = [("id" if i % 2 else "od", i, doc()) for i in range(n_val)]
    return train, val


# None: broadcast; 0: shuffle joins (no key is heavy); 2000: stop-words become heavy keys
@pytest.mark.parametrize("limit", [None, 0, 2000])
def test_fit_answerer_matches_brute_force(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    train, val = _fixture()
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)


def test_answerer_on_ties_and_odd_rows(spark):
    train = [(7, "a b", "x"), (3, "a b", "y"), (-4, "", "empty"), (5, None, "null"), (9, "c " * 500, None), (11, "b a", "y")]
    val = [("id", 1, "a b"), ("id", 2, ""), ("od", 2, None), ("od", 3, "zzz"), ("od", 4, "c d")]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in retrieve.fit_answerer(tdf).retrieve(vdf).collect()}
    # a and b are on three rows, c on one
    assert got == {("id", 1): (3, 2 * (10**9 // 3) * 1000 // 2, "y"), ("od", 4): (9, 10**12, None)}
    assert retrieve.fit_answerer(tdf.limit(0)).retrieve(vdf).collect() == []


def test_search_leaves_long_lists_closed(spark):
    """Rows of rare and common words: most postings are not read, and the result is that of an exhaustive search."""
    rnd = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    train = [(i, " ".join(rnd.sample(common, 20) + [f"t{i % 97}", f"r{i % 41}"]), f"answer {i}") for i in range(400)]
    val = [("id", i, " ".join(rnd.sample(common, 20) + [f"t{rnd.randrange(97)}", f"r{rnd.randrange(41)}"])) for i in range(40)]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)
    work = idx.work(vdf).first()
    assert work["postings"] == sum(sum(t in set(_tokens(o)) for _, o, _ in train) for _, _, v in val for t in set(_tokens(v)))
    assert 0 < work["postings_read"] < 0.2 * work["postings"]


def test_equal_train_rows_are_one_entry_and_lists_come_in_pieces(spark):
    train = [(i, "same words here", f"answer {i}") for i in range(300, 0, -1)] + [(1000 + i, f"same d{i}", "d") for i in range(200)]
    val = [("id", i, "here are the same words") for i in range(3)] + [("od", 9, "same d7")]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    assert idx.rows.count() == 201      # the 300 equal rows are entry of the lowest id
    sizes = idx.pieces.selectExpr("size(entries) AS n", "first").collect()
    assert max(r.n for r in sizes) <= retrieve.PIECE and sum(r.n for r in sizes) == 3 + 2 * 200
    assert sum(r["first"] for r in sizes) == idx.tokens.count()
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)


def test_first_reading_is_short_and_lists_below_the_mean_stay_closed(spark):
    """Many common words and a few rare ones: the first reading takes the rare ones only, and a list whose weight is
    below the mean that is left of the threshold is not read, for no row could reach that mean from it."""
    common = [f"c{i}" for i in range(40)]
    train = [(i, " ".join(common[i % 7:] + [f"r{i}", f"s{i}"]), f"answer {i}") for i in range(120)]
    val = [("id", i, " ".join(common + [f"r{i}", f"s{i}"])) for i in range(0, 120, 3)]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    first, then = idx.search(idx.query_rows(vdf))
    assert first.count() == 2 * len(val)
    assert then.where("weight < 100000000").count() == 0 < then.count()
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)


@pytest.mark.parametrize("block, part", [(60, 1000), (10**9, 4), (100, 6)])
def test_blocks_and_parts_meet_without_shuffled_postings(spark, monkeypatch, block, part):
    """Train rows travel once per part and validation rows once per block, whatever their lists hold."""
    monkeypatch.setattr(retrieve, "BLOCK", block)
    monkeypatch.setattr(retrieve, "PART", part)
    train, val = _fixture(seed=11, n_train=90)
    train += [(1000 + i, o, "later") for i, o, _ in train[:20]]      # ties go to the lower id, in whatever block
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)
    postings = idx.rows.selectExpr("sum(size(numbers))").first()[0]
    blocks, parts = -(-postings // block), -(-len(val) // part)
    assert blocks * parts > 1
    assert idx.cells(idx.query_rows(vdf)).count() == idx.rows.count() * parts + len(val) * blocks


def test_rows_are_not_shuffled_once_per_cell(spark, monkeypatch):
    """Blocks and parts are shuffled a row each, and meet without a further exchange, however many cells there are."""
    monkeypatch.setattr(retrieve, "BLOCK", 60)
    monkeypatch.setattr(retrieve, "PART_TOKENS", 40)
    train, val = _fixture(seed=12)
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    cells = idx.cells(idx.query_rows(vdf))
    assert cells.select("cell").distinct().count() > 20
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[:plan.index("CartesianProduct")]
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in idx.retrieve(vdf).collect()}
    assert got == _brute(train, val)


def test_tokens_of_texts_are_cut_out_in_steps(monkeypatch):
    """The distinct tokens of each text, whatever the steps, empty texts and the slice of a batch."""
    rnd = random.Random(6)
    texts = [None, "", "a", "b", "", "", "\u00e41 x", "\u65e5a9\u672cb a9"] + ["".join(rnd.choice("ab0 -\u00e9\u65e5.\n") for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["", None]
    for step in (retrieve.TEXT_BYTES, 50, 1):
        monkeypatch.setattr(retrieve, "TEXT_BYTES", step)
        got = [[] for _ in texts]
        for start, row, code, dictionary in retrieve._lists_of_texts(pa.array(["zz", *texts]).slice(1)):
            for r, c in zip(row, code):
                got[start + r].append(dictionary[int(c)].as_py())
        assert [sorted(x) for x in got] == [sorted(set(_tokens(x or ""))) for x in texts]


def test_blocks_give_only_rows_that_reach_the_threshold(spark, monkeypatch):
    """Lists of tokens too common to matter are not looked up, and a block without the best row gives none."""
    monkeypatch.setattr(retrieve, "BLOCK", 200)
    common = [f"c{i}" for i in range(20)]
    train = [(i, " ".join(common + [f"r{i}"]), f"answer {i}") for i in range(60)]
    val = [("id", i, " ".join(common + [f"r{i}"])) for i in range(60)]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    cells = idx.cells(idx.query_rows(vdf))
    assert cells.select("cell").distinct().count() > 3
    found = cells.mapInArrow(retrieve._best_rows(idx.steps()), "distribution string, example_id long, train_id long, score long").collect()
    assert sorted((r.example_id, r.train_id) for r in found) == [(i, i) for i in range(60)]
    block = retrieve._Block(np.array([3, 3]), np.array([1, 2]), np.array([3, 3]), np.array([0, 1, 2, 0, 1, 3]))
    opened = retrieve._Opened(block, np.zeros(3, int), np.array([3, 1, 0]), np.array([10**9, 10, 10]), np.array([10**9 * 1000 // 3]))
    assert opened.number.tolist() == [3] and opened.total.tolist() == [0, 10**9, 10**9 + 10, 10**9 + 20]


def test_tables_of_the_search_are_small_on_disk(spark, monkeypatch):
    """Examples and rows of the index are written with a codec that texts and token numbers shrink under."""
    train, val = _fixture()
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    idx = retrieve.fit_answerer(tdf)
    assert all(".zstd." in f for t in (idx.rows, idx.query_rows(vdf)) for f in t.inputFiles())


def test_answerer_reads_whole_rows_of_one_token_and_of_many(spark):
    """Lists of many short rows beside long ones; every weight may be needed."""
    rnd = random.Random(8)
    train = [(i, f"k{i % 9}", f"a{i}") for i in range(300)] + [(500 + i, " ".join(f"k{rnd.randrange(400)}" for _ in range(200)), "long") for i in range(60)]
    val = [("id", i, " ".join(f"k{rnd.randrange(400)}" for _ in range(1 + 12 * i))) for i in range(20)]
    tdf = spark.createDataFrame(train, "example_id long, observations string, response string")
    vdf = spark.createDataFrame(val, "distribution string, example_id long, observations string")
    got = {(r.distribution, r.example_id): (r.train_id, r.score, r.answer) for r in retrieve.fit_answerer(tdf).retrieve(vdf).collect()}
    assert got == _brute(train, val)


def test_largest_rows_of_lists():
    """The bound equals the plain search over sizes."""
    rnd = random.Random(4)
    for _ in range(30):
        weight = sorted((rnd.randint(1, 10**6) for _ in range(rnd.randint(1, 30))), reverse=True)
        goal = rnd.choice([0.0, rnd.uniform(1, 10**6)])
        n = len(weight)
        got = retrieve._largest_rows(np.array(weight), np.full(n, n), np.full(n, goal))
        for j in range(n):
            sizes = [s for s in range(1, 2000) if sum(weight[j:j + s]) * retrieve.SLACK >= goal * s]
            if goal == 0:
                assert got[j] == retrieve.LARGEST
            else:
                assert min(got[j], 1999) == max(sizes, default=0)


@pytest.mark.parametrize("limit", [None, 0, 300])
def test_encode_paths_agree(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    ex = spark.createDataFrame([(1, "the the a b", "c the"), (2, "b zz the", "")],
                               "example_id long, prompt string, response string")
    vocab = encode.build_vocab(ex)
    got = {r.example_id: (list(r.prompt_ids), list(r.answer_ids)) for r in encode.encode_examples(ex, vocab).collect()}
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert got == {1: ([ids["the"]] * 2 + [ids["a"], ids["b"]], [ids["c"], ids["the"]]),
                   2: ([ids["b"], ids["zz"], ids["the"]], [])}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_split_join_matches_plain_join(spark, how):
    # key 0 holds a third of the rows; keys >= 50 have no partner
    big = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 70) for i in range(900)], "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}-{j}") for k in range(50) for j in range(2)], "k long, v string")
    got = sorted(tuple(r) for r in joins.skew_split_join(big, small, ["k"], 2, how, limit=10)
                 .select("id", "k", "v").collect())
    expect = sorted(tuple(r) for r in big.join(small, "k", how).select("id", "k", "v").collect())
    assert got == expect
    heavy = big.groupBy("k").count().where("count > 180").collect()   # T = ceil(900 * 2 / 10)
    assert [r.k for r in heavy] == [0]   # the hot key really takes the heavy path
