import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tripleval.operators import generate as G
from tripleval.operators import metrics as M


def _preds(spark, pairs):
    rows = [("m", "baseline", "id", i, p, r) for i, (p, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model_id string, variant string, distribution string, example_id long, "
                                       "prediction string, reference string")


def _scores(spark, pairs, metrics=M.ALL_METRICS):
    return {r.metric: r.value for r in M.metric_bundle(_preds(spark, pairs), metrics).collect()}


@pytest.mark.parametrize("pred,ref,r1,r2,rl", [
    ("the cat sat", "the cat sat", 1.0, 1.0, 1.0),
    ("the cat", "the dog", 0.5, 0.0, 0.5),
    ("b d c b z", "a b c b d", 0.8, 0.5, 0.6),
    ("", "x", 0.0, 0.0, 0.0),
])
def test_rouge_golden(spark, pred, ref, r1, r2, rl):
    s = _scores(spark, [(pred, ref)], M.ROUGE_KEYS)
    assert s["rouge1"] == pytest.approx(r1) and s["rouge2"] == pytest.approx(r2)
    assert s["rougeL"] == pytest.approx(rl) and s["rougeLsum"] == pytest.approx(rl)


def _dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_bit_parallel_lcs_matches_dp():
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 80))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 80))]
        assert M.lcs_length(a, b) == _dp_lcs(a, b)


def test_union_lcs_paper_example():
    # Lin (2004): r = w1..w5, c1 = w1 w2 w6 w7 w8, c2 = w1 w3 w8 w9 w5 -> union LCS w1 w2 w3 w5
    r = [["w1", "w2", "w3", "w4", "w5"]]
    c = [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    assert M.union_lcs_hits(r, c) == 4


def test_rouge_lsum_multiline(spark):
    s = _scores(spark, [("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")], ["rougeLsum"])
    p, r = 4 / 10, 4 / 5
    assert s["rougeLsum"] == pytest.approx(2 * p * r / (p + r))


def test_zero_overlap_examples_count_in_mean(spark):
    s = _scores(spark, [("a b", "a b"), ("x", "y")], ["rouge1"])
    assert s["rouge1"] == pytest.approx(0.5)


# ---------------------------------------------------------------- BLEU, brute force
def _tok13a(line):
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def _py_corpus_bleu(hyps, refs):
    correct, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for h, r in zip(hyps, refs):
        ht, rt = _tok13a(h), _tok13a(r)
        sys_len += len(ht)
        ref_len += len(rt)
        for n in range(1, 5):
            hg = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            rg = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            correct[n - 1] += sum(min(c, rg[g]) for g, c in hg.items())
            total[n - 1] += max(len(ht) - n + 1, 0)
    if correct[0] == 0 or sys_len == 0:
        return 0.0
    precisions, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            return 0.0
        if correct[n] == 0:
            smooth *= 2
            precisions[n] = 100.0 / (smooth * total[n])
        else:
            precisions[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return bp * math.exp(sum(math.log(p) for p in precisions) / 4)


BLEU_CASES = [
    [("the cat sat on the mat", "the cat sat on the mat")],
    [("the cat sat on a mat today", "the cat sat on the mat"), ("a dog, barked.", "the dog barked loudly.")],
    [("x y", "p q r s")],
    [("alpha beta gamma delta", "alpha beta gamma delta epsilon zeta"), ("one two", "one two three")],
    [("It costs $3.50 now", "It costs $3.50 today"), ("well-known fact", "a well-known fact")],
]


@pytest.mark.parametrize("pairs", BLEU_CASES)
def test_bleu_matches_brute_force(spark, pairs):
    s = _scores(spark, pairs, ["bleu"])
    assert s["bleu"] == pytest.approx(round(_py_corpus_bleu([p for p, _ in pairs], [r for _, r in pairs]), 6),
                                      abs=1e-6)


def test_bleu_identity_is_100(spark):
    s = _scores(spark, [("one two three four five", "one two three four five")], ["bleu"])
    assert s["bleu"] == pytest.approx(100.0)


def test_rouge_bounds_random(spark):
    rnd = random.Random(3)
    pairs = [(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))),
              " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))) for _ in range(40)]
    df = M.example_scores(M.example_stats(_preds(spark, pairs)))
    for r in df.collect():
        for k in M.ROUGE_KEYS:
            assert 0.0 <= r[k] <= 1.0
        assert r.lcs == _dp_lcs(r.prediction.split(), r.reference.split())


def test_overlaps_and_subsequences_of_a_batch():
    """Counted for all rows of a batch at once, in steps, with null, empty and long lists and slices."""
    rnd = random.Random(2)
    def toks(n):
        return [rnd.choice("abcde") for _ in range(rnd.randint(0, n))]
    a = [None, [], ["a"] * 300] + [toks(9) for _ in range(200)]
    b = [["a"], ["b"], ["a"] * 299 + ["b"]] + [toks(9) for _ in range(200)]
    kind = pa.list_(pa.string())
    grams = lambda x, n: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
    for held in (M.HELD_TOKENS, 5):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(M, "HELD_TOKENS", held)
            got = M.clipped_overlaps(pa.array([["x"], *a], kind).slice(1), pa.array(b, kind), 4)
        assert got.tolist() == [[sum((grams(x or [], n) & grams(y, n)).values()) for x, y in zip(a, b)] for n in range(1, 5)]
    lines = pa.list_(kind)
    refs, preds = [[x] if x else [] for x in a] + [[["a", "b"], ["c"]]], [[x] for x in b] + [[["c", "a"], ["b"]]]
    assert M._per_pair(M.union_lcs_hits, pa.array(refs, lines), pa.array(preds, lines)).to_pylist() == [M.union_lcs_hits(r, p) for r, p in zip(refs, preds)]
    with pytest.raises(TypeError):
        M._per_pair(M.lcs_length, pa.array(a, kind), pa.array(b, kind))


def test_equal_pairs_are_compared_once_and_prompts_made_before_the_fan_out(spark, monkeypatch):
    calls = []
    refs, preds = pa.array([["a", "b"]] * 6), pa.array([["a"], ["b", "a"], ["b"], ["b", "a"], ["a", "c"], ["b", "a"]])
    assert M._per_pair(lambda r, p: calls.append(p) or len(p), refs, preds).to_pylist() == [1, 2, 1, 2, 2, 2] and len(calls) == 4
    inputs = spark.createDataFrame([("id", 1, "o", "q", "r", "x")], "distribution string, example_id long, observations string, question string, reference string, answer string")
    plan = G.generate_native_variants(inputs, ["lead", "echo"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Training Observations" in plan[plan.index("Generate "):] and "Training Observations" not in plan[:plan.index("Generate ")]
