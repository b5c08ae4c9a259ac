"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates.  The lexicon has a fixed seed and words and word beginnings learned from
labelled rows by their log odds.  Learning reads a bounded sample of labelled rows
(``MAX_TRAINING_ROWS``), of which disjoint parts teach the lexicon, the trees and the
calibration; scoring reads every document once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .shingles import give_back, steps, word_codes

# Bounds of what is learned (parameters of ``score``): labelled rows, and items of the lexicon.
MAX_TRAINING_ROWS = 40_000
MAX_LEXICON = 4_000
FOLDS = 5
LEAST_DOCUMENTS = 3
LEAST_Z = 3.0
TREES = 20
DEPTH = 4
SEED = 11
NEAR = 5
# Words with their features that a task remembers; beyond it starts anew.
REMEMBERED_WORDS = 200_000
TEXT_STEP = 2 << 20

SEED_WORDS = ("idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb fool jerk "
              "idiota estúpido imbécil tonto basura dummkopf trottel abschaum widerlich dumm "
              "imbécile stupide crétin ordure débile").split()
SECOND_PERSON = frozenset("you your yours yourself u ur ya thou du dich dir dein deine ihr euch tu te toi ton ta tes vous "
                          "votre vos tú ti usted ustedes vosotros su".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
LETTERS = re.compile(r"[^\W\d_]+")

FEATURES = ("log_words seed_density learned_density weight_density strong_density strong_count_log prefix_density "
            "strong_prefix_density strong_prefix_count_log best_weight best_prefix near_you_density you_density capital_rate "
            "shout_rate exclamation_rate question_rate punctuation_rate symbol_rate digit_rate obfuscated_rate hidden_density "
            "mean_length").split()


def word_parts(word: str) -> list[str]:
    """Lexicon items of a word: its runs of letters and their first four and five letters."""
    items = []
    for run in LETTERS.findall(word.lower()):
        items.append(run)
        if len(run) > 4:
            items.append(run[:4] + "-")
        if len(run) > 5:
            items.append(run[:5] + "-")
    return items


class WordFeatures:
    """Per distinct word: [seed, learned, weight, strong, prefix, strong prefix, you, capitals, letters, shout,
    exclamations, questions, punctuation, symbols, digits, obfuscated, hidden, length, best, best prefix]."""

    WIDTH = 20

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seed = lexicon, frozenset(SEED_WORDS)
        self.known: dict[str, tuple] = {}
        self.same: dict[tuple, tuple] = {}

    def of(self, word: str) -> tuple:
        row = self._of(word)
        row = self.same.setdefault(row, row)        # few distinct rows: one object each
        if len(self.known) >= REMEMBERED_WORDS:
            self.known.clear()
            self.same.clear()
        if len(word) <= 64:
            self.known[word] = row
        return row

    def _of(self, word: str) -> tuple:
        core = word if word.isalpha() else word.rstrip(".,;:!?")
        if not core.isalpha():
            return self._any(word)
        low, tail = core.lower(), word[len(core):]
        n = len(low)
        get = self.lexicon.get
        w = get(low, 0.0)
        p = 0.0 if n < 5 else get(low[:4] + "-", 0.0) if n == 5 else max(get(low[:4] + "-", 0.0), get(low[:5] + "-", 0.0))
        capitals = 0 if core.islower() else sum(map(str.isupper, core))
        calls, asks = (tail.count("!"), tail.count("?")) if tail else (0, 0)
        return (low in self.seed, w > 0, w, w >= 2, p > 0, p >= 2, low in SECOND_PERSON, capitals, n, capitals == n > 2,
                calls, asks, len(tail) - calls - asks, 0, 0, 0, 0, len(word), w, p)

    def _any(self, word: str) -> tuple:
        runs = LETTERS.findall(word.lower())
        seed = learned = strong = prefix = strong_prefix = you = 0
        weight = best = best_prefix = 0.0
        for run in runs:
            seed += run in self.seed
            you += run in SECOND_PERSON
            w = self.lexicon.get(run, 0.0)
            learned += w > 0
            strong += w >= 2
            weight += w
            best = max(best, w)
            p = max(self.lexicon.get(run[:4] + "-", 0.0) if len(run) > 4 else 0.0,
                    self.lexicon.get(run[:5] + "-", 0.0) if len(run) > 5 else 0.0)
            prefix += p > 0
            strong_prefix += p >= 2
            best_prefix = max(best_prefix, p)
        letters = sum(map(len, runs))
        capitals = sum(map(str.isupper, word))
        inner = word.strip(".,;:!?\"'()[]{}-*&%$#")
        digits = sum(map(str.isdigit, word))
        obfuscated = hidden = 0
        if inner and not inner.isalpha() and letters:
            obfuscated = 1
            plain = "".join(LETTERS.findall(inner.lower().translate(LEET)))
            hidden = int(plain in self.seed or self.lexicon.get(plain, 0.0) >= 2) if not seed and not strong else 0
        marks = [sum(map(word.count, s)) for s in ("!", "?", ".,;:'\"()-", "*&%$#@^~|<>=+/\\")]
        shout = int(capitals == letters and letters > 2)
        return (seed, learned, weight, strong, prefix, strong_prefix, you, capitals, letters, shout, *marks, digits,
                obfuscated, hidden, len(word), best, best_prefix)


def text_features(texts: pa.StringArray, words: WordFeatures) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    out = []
    for first, last in steps(texts, TEXT_STEP):
        codes, distinct, counts = word_codes(texts.slice(first, last - first))
        known = list(map(words.known.get, distinct))
        rows = [words.of(w) if r is None else r for w, r in zip(distinct, known)]
        each = np.fromiter(chain.from_iterable(rows), np.float32, len(rows) * WordFeatures.WIDTH)
        each = np.ascontiguousarray(each.reshape(-1, WordFeatures.WIDTH).T)
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        total = np.zeros((n, WordFeatures.WIDTH))
        for k in range(18):
            if each[k].any():
                total[:, k] = np.bincount(owner, each[k][codes], n)
        for k in (18, 19):
            hit = np.flatnonzero(each[k][codes])
            np.maximum.at(total[:, k], owner[hit], each[k][codes[hit]])
        seen = np.concatenate([[0], np.cumsum(each[6][codes] > 0)])
        begin = (np.cumsum(counts) - counts)[owner] if len(owner) else owner
        end = np.cumsum(counts)[owner] if len(owner) else owner
        at = np.arange(len(codes))
        close = seen[np.minimum(at + NEAR + 1, end)] > seen[np.maximum(at - NEAR, begin)]
        bad = ((each[0] > 0) | (each[3] > 0) | (each[5] > 0))[codes]
        near = np.bincount(owner, close & bad, n)
        w, letters, chars = np.maximum(counts, 1), np.maximum(total[:, 8], 1), np.maximum(total[:, 17], 1)
        t = total.T
        out.append(np.stack([
            np.log1p(counts), t[0] / w, t[1] / w, t[2] / w, t[3] / w, np.log1p(t[3]), t[4] / w, t[5] / w, np.log1p(t[5]), t[18],
            t[19], near / w, t[6] / w, t[7] / letters, t[9] / w, t[10] / w, t[11] / w, t[12] / chars, t[13] / chars, t[14] / chars,
            t[15] / w, t[16] / w, t[17] / w], axis=1))
    return np.concatenate(out) if out else np.empty((0, len(FEATURES)))


def held_out(doc_id: Column) -> Column:
    """Rows that no step learns from: crc32 of the id as text, modulo 5, is 0 (a null id: too)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """About ``most`` labelled ids at most (by hash), with ``part``: 0-2 lexicon, 3-7 trees, 8-9 calibration."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").cast("double").alias("_toxic"))
    n = max(1, usable.count())
    share = int((1 << 30) * min(1.0, most / n))
    return usable.where(F.pmod(F.xxhash64("_label_id", F.lit("sample")), F.lit(1 << 30)) < share) \
        .withColumn("_part", F.pmod(F.xxhash64("_label_id", F.lit("part")), F.lit(10)))


def learn_lexicon(rows: DataFrame, most: int = MAX_LEXICON) -> dict[str, float]:
    """Log odds of the items that occur in clearly more toxic than other documents (columns text, _toxic): the
    ``most`` items of the clearest odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, float], int] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count.update((item, toxic) for item in {i for w in set(text.split()) for i in word_parts(w)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.string()),
                                          pa.array([n if t else 0 for (_, t), n in count.items()], pa.int64()),
                                          pa.array([0 if t else n for (_, t), n in count.items()], pa.int64())],
                                         names=["item", "bad", "good"])

    totals = rows.agg(F.coalesce(F.sum("_toxic"), F.lit(0.0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = totals["bad"] + 1, totals["n"] - totals["bad"] + 1
    counts = rows.select(F.coalesce("text", F.lit("")).alias("text"), "_toxic").mapInArrow(run, "item string, bad long, good long") \
        .groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = counts.where(F.col("bad") >= LEAST_DOCUMENTS).select("item", odds.alias("odds"), z.alias("z")) \
        .where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "item").limit(most).collect()
    return {r["item"]: min(r["odds"], 6.0) for r in found if r["odds"] > 0}


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, lexicon_items: int = MAX_LEXICON) -> DataFrame:
    """``docs`` with ``tox_held_out``, ``tox_score`` (0 to 1) and ``tox_predicted`` (score >= 0.5).

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; null labels teach nothing, repeated ones
    count once.  Null and empty texts have a score too: of features that are all zero.  Where the
    labelled rows lack one of the classes, every score is the share of label 1 (0 without rows).
    ``most`` bounds the labelled rows that are learned from, ``lexicon_items`` the learned lexicon (the
    items of the clearest odds stay).  Other columns are kept whatever their names and types; only a
    column named like one of the three results is replaced by it.
    """
    results = ["tox_held_out", "tox_score", "tox_predicted"]
    out = _scored(docs, labels, most, lexicon_items)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in results), *results)


def _scored(docs: DataFrame, labels: DataFrame, most: int, lexicon_items: int) -> DataFrame:
    """row (all columns of ``docs``) and the three results."""
    out = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text")) \
        .withColumn("tox_held_out", held_out(F.col("doc_id")))
    docs = docs.select("doc_id", "text")
    known = write_table(training_labels(labels, most), "tox-labels")
    rows = docs.select(F.col("doc_id").alias("_label_id"), "text").join(F.broadcast(known), "_label_id")
    rows = write_table(rows, "tox-rows")
    lexicon = learn_lexicon(rows.where("_part < 3"), lexicon_items)

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordFeatures(lexicon)
        for texts in batches:
            x = text_features(texts, words)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            give_back()

    vector = array_to_vector(features(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    fit = write_table(rows.select(features(F.coalesce("text", F.lit(""))).alias("x"), "_toxic", "_part"), "tox-features")
    fit = fit.select(array_to_vector("x").alias("tox_vector"), "_toxic", "_part").coalesce(4)
    trees_rows, calibration = fit.where("_part between 3 and 7"), fit.where("_part >= 8")
    counts = fit.groupBy((F.col("_part") >= 8).alias("cal")).agg(F.sum("_toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["cal"]: (r["bad"], r["n"]) for r in counts}
    bad, n = by.get(False, (0, 0))
    if not 0 < trees_rows.agg(F.coalesce(F.sum("_toxic"), F.lit(0.0))).first()[0] < trees_rows.count():
        share = (bad + by.get(True, (0, 0))[0]) / max(1, n + by.get(True, (0, 0))[1])
        return out.withColumn("tox_score", F.lit(float(share))).withColumn("tox_predicted", (F.col("tox_score") >= 0.5).cast("int"))
    trees = GBTClassifier(featuresCol="tox_vector", labelCol="_toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED,
                          predictionCol="tox_class").setRawPredictionCol("tox_raw").setProbabilityCol("tox_probability").fit(trees_rows)
    raw = vector_to_array("tox_probability")[1]
    line: list[tuple[float, float]] = []
    if 0 < by.get(True, (0, 0))[0] < by.get(True, (0, 0))[1]:
        curve = IsotonicRegression(featuresCol="tox_p", labelCol="_toxic", predictionCol="tox_line") \
            .fit(trees.transform(calibration).select(raw.alias("tox_p"), "_toxic"))
        line = sorted(zip(map(float, curve.boundaries), map(float, curve.predictions)))
    scored = trees.transform(out.withColumn("tox_vector", vector)).withColumn("tox_p", raw)
    return scored.withColumn("tox_score", calibrated(F.col("tox_p"), line)) \
        .drop("tox_vector", "tox_raw", "tox_probability", "tox_class", "tox_p") \
        .withColumn("tox_predicted", (F.col("tox_score") >= 0.5).cast("int"))


def calibrated(p: Column, line: list[tuple[float, float]]) -> Column:
    """Isotonic calibration: the step function's value, with a thousandth of the raw probability mixed
    in, so that documents on one step keep their order."""
    if not line:
        return p
    value = F.lit(line[0][1])
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        if x1 > x0 and y1 >= y0:
            value = F.when(p >= x0, F.lit(y0) + (F.least(p, F.lit(x1)) - x0) * ((y1 - y0) / (x1 - x0))).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * (1 - 1e-3) + p * 1e-3))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, lexicon_items: int = MAX_LEXICON) -> DataFrame:
    """``docs`` without those predicted toxic; columns of any names and types stay as they are."""
    return _scored(docs, labels, most, lexicon_items).where("tox_predicted = 0").select("row.*")
