"""Corpus metrics: ROUGE-1/2/L/Lsum (mean of per-example F1) and corpus BLEU-4.

Plan shape
----------
Tokenisation is by column expressions.  Clipped n-gram overlaps (ROUGE-1/2, BLEU)
and longest common subsequences (ROUGE-L, ROUGE-Lsum) are counted map-side in an
Arrow-batched UDF, so no n-gram crosses a shuffle.  The n-grams of a batch are
numbered, an n-gram by its first n - 1 tokens' number and its last token, and
counted for all rows at once; subsequences take bit-parallel rows, |a| * |b| /
wordsize steps for two token lists.  Only what a wanted metric needs is counted.  The only
shuffle is the final grouped aggregation, whose partial sums are combined
map-side: one row per (model, variant, distribution) leaves each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import bleu_tokens, rouge_tokens

GROUP = ["model_id", "variant", "distribution"]
ROUGE_KEYS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]
ALL_METRICS = ROUGE_KEYS + ["bleu"]

LENGTHS = ["r_pred_len", "r_ref_len", "r2_pred_len", "r2_ref_len", "lsum_pred_len", "lsum_ref_len", "sys_len", "ref_len"]
HITS = ["r1_hit", "r2_hit", "b1", "b2", "b3", "b4"]
LCS = ["lcs", "lsum_hit"]
# Tokens of both sides, about, whose n-grams are counted at a time.
HELD_TOKENS = 1 << 20
# Pairs of a prediction and a reference whose subsequence is remembered.
KNOWN_PAIRS = 16


# ------------------------------------------------------------------ per-row kernels
def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.Array) -> pa.Array:
    """The elements of all lists; of no list, whose buffers may be missing, none."""
    return lists.flatten() if len(lists) else pa.array([], lists.type.value_type)


def _overlaps(a: pa.Array, b: pa.Array, orders: int) -> np.ndarray:
    """``clipped_overlaps`` of rows that are held at once."""
    n, lens = len(a), np.concatenate([_lengths(a), _lengths(b)])
    flat = pa.concat_arrays([_flat(a), _flat(b)]).dictionary_encode()
    token = flat.indices.to_numpy().astype(np.int64)
    side_row = np.repeat(np.arange(2 * n), lens)       # rows of a, then rows of b
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(token))     # tokens from this one to the end of its list
    at, gram, out = np.arange(len(token)), token, np.zeros((orders, n), np.int64)
    for order in range(1, orders + 1):
        if order > 1:
            longer = left[at] >= order
            at = at[longer]
            gram = np.unique(gram[longer] * len(flat.dictionary) + token[at + order - 1], return_inverse=True)[1]
        if not len(at):
            break
        n_grams, rows = gram.max() + 1, side_row[at]
        mine, count = np.unique(rows * n_grams + gram, return_counts=True)
        cut = np.searchsorted(mine, n * n_grams)
        _, i, j = np.intersect1d(mine[:cut], mine[cut:] - n * n_grams, assume_unique=True, return_indices=True)
        np.add.at(out[order - 1], mine[i] // n_grams, np.minimum(count[i], count[cut + j]))
    return out


def clipped_overlaps(a: pa.Array, b: pa.Array, orders: int) -> np.ndarray:
    """Per order of n-grams from 1 to ``orders`` and per row, the sum over grams of min(count in a, count in b), for two
    arrays of token lists.  A null list has no grams."""
    ends, start, out = np.cumsum(_lengths(a) + _lengths(b)), 0, np.zeros((orders, len(a)), np.int64)
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD_TOKENS, side="right")))
        out[:, start:stop] = _overlaps(a.slice(start, stop - start), b.slice(start, stop - start), orders)
        start = stop
    return out


def _lcs_rows(a, b) -> tuple[list[int], int]:
    """Bit rows of the LCS table, one per token of ``b``: bit i is 0 where the length grows at a[i] (Hyyro 2004)."""
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, rows = full, []
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows, full


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence: |a| * |b| / wordsize steps."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_positions(ref, cand) -> list[int]:
    """Positions in ``ref`` of one longest common subsequence, read off the bit rows from the end:
    where the length does not grow at a position, that position is left out."""
    if len(ref) == 0 or len(cand) == 0:
        return []
    rows, _ = _lcs_rows(ref, cand)
    i, j, out = len(ref), len(cand), []
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def union_lcs_hits(ref_lines, pred_lines) -> int:
    """Summary-level LCS hits: per reference line the union of its common positions with every
    predicted line; a token hits at most as often as the prediction has it."""
    ref_lines, pred_lines = [list(x) for x in ref_lines], [list(x) for x in pred_lines]
    if len(ref_lines) == len(pred_lines) == 1:      # the prediction has every token of a common subsequence as often
        return lcs_length(ref_lines[0], pred_lines[0])
    left = Counter(t for line in pred_lines for t in line)
    hits = 0
    for ref in ref_lines:
        found = set().union(*(lcs_positions(ref, line) for line in pred_lines))
        for tok, n in Counter(ref[i] for i in found).items():
            n = min(n, left[tok])
            left[tok] -= n
            hits += n
    return hits


def _numbered(*lists: pa.Array) -> Iterator[list]:
    """The lists as Python's, equal tokens as equal numbers."""
    flat, depth = [_flat(x) for x in lists], 1
    if pa.types.is_list(flat[0].type):
        inner, flat, depth = flat, [_flat(x) for x in flat], 2
    token = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy()
    ends = np.cumsum([len(x) for x in flat])
    for k, x in enumerate(lists):
        out = token[ends[k] - len(flat[k]):ends[k]].tolist()
        for level in [inner[k], x] if depth == 2 else [x]:
            bounds = np.concatenate([[0], np.cumsum(_lengths(level))]).tolist()
            out = [out[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
        yield out


def _per_pair(count: Callable, refs: pa.Array, preds: pa.Array) -> pa.Array:
    """``count`` of each row's pair; rows that follow one another are counted once if they are equal to a recent one.
    A null has no subsequence and is an error."""
    if refs.null_count or preds.null_count:
        raise TypeError("a prediction or a reference is null")
    out, known = np.zeros(len(refs), np.int64), {}
    for k, (r, p) in enumerate(zip(*_numbered(refs, preds))):
        pair = repr((r, p)) if r and p else ""
        if pair and pair not in known:
            if len(known) >= KNOWN_PAIRS:
                known.clear()
            known[pair] = count(r, p)
        out[k] = known[pair] if pair else 0
    return pa.array(out)


def _counts_udf(want: frozenset):
    """The hits of the wanted metrics; those of n-grams are null where a side is null."""
    fields = [("r1_hit", "rouge1"), ("r2_hit", "rouge2"), *((f"b{n}", "bleu") for n in range(1, 5)), ("lcs", "rougeL"), ("lsum_hit", "rougeLsum")]
    names = [name for name, metric in fields if metric in want]

    @arrow_udf(", ".join(f"{name} long" for name in names))
    def counts(rp: pa.Array, rr: pa.Array, rpl: pa.Array, rrl: pa.Array, bp: pa.Array, br: pa.Array) -> pa.Array:
        found = {}
        if want & {"rouge1", "rouge2"}:
            hits = clipped_overlaps(rp, rr, 2 if "rouge2" in want else 1)
            null = pc.or_(rp.is_null(), rr.is_null()).to_numpy(zero_copy_only=False)
            found |= {f"r{n + 1}_hit": pa.array(h, mask=null) for n, h in enumerate(hits)}
        if "bleu" in want:
            null = pc.or_(bp.is_null(), br.is_null()).to_numpy(zero_copy_only=False)
            found |= {f"b{n + 1}": pa.array(h, mask=null) for n, h in enumerate(clipped_overlaps(bp, br, 4))}
        if "rougeL" in want:
            found["lcs"] = _per_pair(lcs_length, rr, rp)
        if "rougeLsum" in want:
            found["lsum_hit"] = _per_pair(union_lcs_hits, rrl, rpl)
        return pa.StructArray.from_arrays([found[name] for name in names], names=names)
    return counts, names


def _line_tokens(c: Column) -> Column:
    """Token lists of the non-empty lines of a text."""
    return F.transform(F.filter(F.split(c, "\n"), lambda x: F.length(x) > 0), rouge_tokens)


# Reference token columns a caller may carry (tokenised once per example before
# fanning out to models and variants); computed here when absent.
REF_TOKEN_COLS = {"ref_rouge_tokens": lambda c: rouge_tokens(c), "ref_line_tokens": lambda c: _line_tokens(c),
                  "ref_bleu_tokens": lambda c: bleu_tokens(c)}


def reference_tokens(df: DataFrame, metrics=ALL_METRICS) -> DataFrame:
    """Add the reference token columns the wanted metrics need."""
    want = frozenset(metrics)
    need = {"ref_rouge_tokens": True, "ref_line_tokens": "rougeLsum" in want, "ref_bleu_tokens": "bleu" in want}
    for name, fn in REF_TOKEN_COLS.items():
        if need[name]:
            df = df.withColumn(name, fn(F.col("reference")))
    return df


def example_stats(predictions: DataFrame, metrics=ALL_METRICS) -> DataFrame:
    """Per-example counts; keeps all input columns."""
    want = frozenset(metrics)
    empty = F.array().cast("array<string>")
    empty2 = F.array().cast("array<array<string>>")
    cols = set(predictions.columns)

    def ref(name: str) -> Column:
        return F.col(name) if name in cols else REF_TOKEN_COLS[name](F.col("reference"))

    rp = rouge_tokens(F.col("prediction"))
    with_tokens = predictions.select(
        "*", rp.alias("_rp"), ref("ref_rouge_tokens").alias("_rr"),
        (_line_tokens(F.col("prediction")) if "rougeLsum" in want else empty2).alias("_rpl"),
        (ref("ref_line_tokens") if "rougeLsum" in want else empty2).alias("_rrl"),
        (bleu_tokens(F.col("prediction")) if "bleu" in want else empty).alias("_bp"),
        (ref("ref_bleu_tokens") if "bleu" in want else empty).alias("_br"))
    zero = F.lit(0).cast("long")
    counts, names = _counts_udf(want)
    if names:
        with_tokens = with_tokens.withColumn("_hits", counts("_rp", "_rr", "_rpl", "_rrl", "_bp", "_br"))
    hits = [(F.col(f"_hits.{name}") if name in names else zero).alias(name) for name in [*HITS, *LCS]]
    lens = [F.size("_rp"), F.size("_rr"), F.greatest(F.size("_rp") - 1, F.lit(0)), F.greatest(F.size("_rr") - 1, F.lit(0)),
            F.aggregate("_rpl", F.lit(0), lambda a, x: a + F.size(x)),
            F.aggregate("_rrl", F.lit(0), lambda a, x: a + F.size(x)), F.size("_bp"), F.size("_br")]
    counted = [c.alias(n) for c, n in zip(lens, LENGTHS)]
    return with_tokens.select(*predictions.columns, *counted, *hits)


# ------------------------------------------------------------------ scores
def _f1(hit: Column, pred_len: Column, ref_len: Column, zero_if_empty: bool = False) -> Column:
    p = hit / F.greatest(pred_len, F.lit(1))
    r = hit / F.greatest(ref_len, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    if zero_if_empty:
        f = F.when((pred_len == 0) | (ref_len == 0), F.lit(0.0)).otherwise(f)
    return f.cast("double")


def example_scores(stats: DataFrame) -> DataFrame:
    """Per-example ROUGE F1 values."""
    return stats.select(
        "*",
        _f1(F.col("r1_hit"), F.col("r_pred_len"), F.col("r_ref_len")).alias("rouge1"),
        _f1(F.col("r2_hit"), F.col("r2_pred_len"), F.col("r2_ref_len")).alias("rouge2"),
        _f1(F.col("lcs"), F.col("r_pred_len"), F.col("r_ref_len"), True).alias("rougeL"),
        _f1(F.col("lsum_hit"), F.col("lsum_pred_len"), F.col("lsum_ref_len"), True).alias("rougeLsum"))


def corpus_bleu(m: list[Column], t: list[Column], sys_len: Column, ref_len: Column) -> Column:
    """sacreBLEU closed form over summed statistics; exponential smoothing; 0-100 scale."""
    logs = []
    zeros = F.lit(0)
    for n in range(4):
        zeros = zeros + F.when(m[n] == 0, 1).otherwise(0)
        safe_t = F.when(t[n] > 0, t[n]).otherwise(F.lit(1))
        p = F.when(m[n] > 0, 100.0 * m[n] / safe_t).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * safe_t))
        logs.append(F.log(p))
    safe_sys = F.when(sys_len > 0, sys_len).otherwise(F.lit(1))
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1.0 - ref_len / safe_sys))
    score = bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4.0)
    return F.when((m[0] == 0) | (t[3] == 0) | (sys_len == 0), F.lit(0.0)).otherwise(score)


def corpus_metrics(scores: DataFrame, metrics=ALL_METRICS, group=GROUP) -> DataFrame:
    """Long table (group..., metric, value, n_examples)."""
    aggs = [F.count(F.lit(1)).alias("n_examples")]
    aggs += [F.avg(k).alias(k) for k in ROUGE_KEYS if k in metrics]
    if "bleu" in metrics:
        aggs += [F.sum(f"b{n}").alias(f"M{n}") for n in range(1, 5)]
        aggs += [F.sum(F.greatest(F.col("sys_len") - (n - 1), F.lit(0))).alias(f"T{n}") for n in range(1, 5)]
        aggs += [F.sum("sys_len").alias("S"), F.sum("ref_len").alias("R")]
    g = scores.groupBy(*group).agg(*aggs)
    pairs = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
             for k in ROUGE_KEYS if k in metrics]
    if "bleu" in metrics:
        bleu = corpus_bleu([F.col(f"M{n}") for n in range(1, 5)], [F.col(f"T{n}") for n in range(1, 5)],
                           F.col("S"), F.col("R"))
        pairs.append(F.struct(F.lit("bleu").alias("metric"), bleu.cast("double").alias("value")))
    return (g.select(*group, "n_examples", F.explode(F.array(*pairs)).alias("m"))
            .select(*group, "m.metric", F.round("m.value", 6).alias("value"), "n_examples"))


def metric_bundle(predictions: DataFrame, metrics=ALL_METRICS, group=GROUP) -> DataFrame:
    return corpus_metrics(example_scores(example_stats(predictions, metrics)), metrics, group)


Scorer = Callable[[Column, Column], Column]


def scored_means(predictions: DataFrame, scorers: Mapping[str, Scorer], group=GROUP) -> DataFrame:
    """Further metrics as rows of the metrics table: the mean of each scorer over the examples."""
    scores = [F.struct(F.lit(name).alias("metric"), fn(F.col("prediction"), F.col("reference")).cast("double").alias("value"))
              for name, fn in scorers.items()]
    return (predictions.select(*group, F.explode(F.array(*scores)).alias("s")).groupBy(*group, "s.metric")
            .agg(F.round(F.avg("s.value"), 6).alias("value"), F.count(F.lit(1)).alias("n_examples")))
