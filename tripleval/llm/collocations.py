"""Phrase collocations by Rabin-Karp fingerprints.

1. A task turns its texts into word hashes and takes prefix polynomials of them, so that the
   fingerprint of any n-gram is one difference and one product.  Language and length are part of it.
2. Equal fingerprints of a step of texts are counted at once; what travels is a fingerprint, some bits of a
   second and independent one (the proof), the count, and a pointer to one occurrence (hash of the text,
   byte offset).  They meet sorted, and totals are taken from the sorted stream in bounded memory.
3. Single words and pairs go first.  A fixed-size bitmap of the frequent pairs' fingerprints then
   keeps three- and four-word phrases at home that hold an infrequent pair; it may let others pass, never
   too few.
4. A fingerprint whose proofs differ holds several phrases: those are counted apart.
5. Only frequent phrases become text: their pointers join the texts, and what they point at must
   give the fingerprint again.
6. Scores, cuts and the rule of longer phrases are joins and aggregates of that small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .shingles import give_back, hash_words, mix64, steps, word_codes

LEAST = 30
TOP = 2000
LONGEST = 4
NO_LANGUAGE = "und"
# A longer phrase with this share of a candidate's count, in percent, replaces it.
COVERED = 80
SCALE = 2_000_000

STEP_BYTES = 6 << 20
BATCH_ROWS = 1 << 16
# Rows that a task gathers from its steps before it sends their totals.
GATHERED_ROWS = 2_500_000
PROOF_BITS = 16
# Bits of the map of frequent pairs: 8 MB at any size of the corpus.
FILTER_BITS = 26

MULTIPLIER = 0x2545F4914F6CDD1D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LENGTH_STEPS = np.arange(LONGEST + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
CHECK_KEY = "2nd fingerprints"      # 16 bytes

# Kinds of bytes (0 part of a word, 1 between words, 2 between pieces).
BETWEEN_WORDS = b" \t"
BETWEEN_PIECES = b".,;:!?\n\x0b\x0c\r"

# place: byte offset of the first word, times 8, plus the number of words
COUNTED = "fp long, proof int, times int, text_hash long, place long"
TOTALS = "fp long, f long, mixed boolean, text_hash long, place long"


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, np.uint8)
    kind[list(BETWEEN_WORDS)] = 1
    kind[list(BETWEEN_PIECES)] = 2
    plain = np.arange(256, dtype=np.uint8)
    plain[ord("A"):ord("Z") + 1] += 32
    plain[kind > 0] = ord(" ")
    return kind, plain


def seeds(langs: list[str]) -> np.ndarray:
    return hash_words(langs)


def prefix_polynomials(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[i] * INVERSE**i and the powers of MULTIPLIER: words s to s + n have the polynomial
    (sums[s + n] - sums[s]) * powers[s]."""
    sums = np.full(len(h) + 1, np.uint64(INVERSE))
    sums[0] = 1
    np.cumprod(sums, out=sums)
    sums[1:] = sums[:-1] * h
    sums[0] = 0
    np.cumsum(sums, out=sums)
    powers = np.full(len(h) + 1, np.uint64(MULTIPLIER))
    powers[0] = 1
    return sums, np.cumprod(powers, out=powers)


def fingerprint(polynomial: np.ndarray, seed: np.ndarray, size: int, bits: int = 64) -> np.ndarray:
    """Fingerprints of phrases of one size, of which the upper ``bits`` bits are kept."""
    return mix64(mix64(polynomial + LENGTH_STEPS[size]) + seed) >> np.uint64(64 - bits) << np.uint64(64 - bits)


class Step:
    """Words of some texts: hashes, byte ranges, and the piece that each lies in."""

    def __init__(self, texts: pa.StringArray, seed: np.ndarray, fp_bits: int = 64):
        self.fp_bits = fp_bits
        kind, plain = _byte_tables()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        kinds = kind[data]
        inside = kinds == 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        opens[first] = inside[first]                     # a text's first byte opens a word whatever stands before
        self.start = np.flatnonzero(opens)
        split = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(plain[data]))
        codes, distinct, counts = word_codes(split)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.offsets, self.seed = offsets, seed[self.owner]
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), self.start) + self.owner
        self.codes, self.hashes = codes, hash_words(distinct)[codes]
        self.proofs = pd.util.hash_array(np.asarray(distinct, dtype=object), hash_key=CHECK_KEY, categorize=False)[codes] \
            if distinct else np.empty(0, np.uint64)
        self.sums, self.powers = prefix_polynomials(self.hashes)
        self.proof_sums, _ = prefix_polynomials(self.proofs)

    def grams(self, size: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of the phrases of ``size`` words inside one piece, of those that start at ``at``."""
        n = max(0, len(self.hashes) - size + 1)
        if at is None:
            at = np.arange(n)
        at = at[at < n]
        at = at[self.piece[at] == self.piece[at + size - 1]]
        return at, fingerprint((self.sums[at + size] - self.sums[at]) * self.powers[at], self.seed[at], size, self.fp_bits)

    def empty(self, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the empty phrase of each word's language."""
        return fingerprint(np.zeros(len(at), np.uint64), self.seed[at], 0, self.fp_bits)

    def proof(self, at: np.ndarray, size: int) -> np.ndarray:
        words = (self.proof_sums[at + size] - self.proof_sums[at]) * self.powers[at]
        return (mix64(mix64(words) + self.seed[at] * np.uint64(MULTIPLIER)) >> np.uint64(64 - PROOF_BITS)).astype(np.int32)


def tally(fp: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one occurrence, number) of each distinct pair of fingerprint and proof."""
    if not len(fp):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(fp)
    new = np.ones(len(fp), bool)
    new[1:] = fp[order[1:]] != fp[order[:-1]]
    if (~new[1:] & (proof[order[1:]] != proof[order[:-1]])).any():
        order = np.lexsort((proof, fp))
        new[1:] = (fp[order[1:]] != fp[order[:-1]]) | (proof[order[1:]] != proof[order[:-1]])
    first = np.flatnonzero(new)
    return order[first], np.diff(first, append=len(fp))


def _has(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    slot = fp >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _occurrences(step: Step, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, fingerprints): words and pairs, or with a map of frequent pairs, longer phrases."""
    if bits is None:
        yield 1, *step.grams(1)
        yield 2, *step.grams(2)
        return
    at, fp = step.grams(2)
    pair = np.zeros(len(step.hashes) + LONGEST, bool)
    pair[at] = _has(bits, fp)
    good = pair[:len(step.hashes)]
    for size in range(3, LONGEST + 1):
        good = good & pair[size - 2:size - 2 + len(good)]
        yield size, *step.grams(size, np.flatnonzero(good))


def _step_rows(step: Step, marks: np.ndarray, bits: np.ndarray | None) -> list[np.ndarray]:
    """Columns fp, proof, times, text_hash, place of the phrases of a step."""
    found = list(_occurrences(step, bits))
    if bits is None:        # the empty phrase counts the words of a language
        at = np.arange(len(step.hashes))
        found.append((0, at, step.empty(at)))
    out = []
    for size, at, fp in found:
        proof = step.proof(at, size)
        one, times = tally(fp, proof)
        at = at[one]
        owner = step.owner[at]
        out.append([fp[one], proof[one], times.astype(np.int32), marks[owner], (step.start[at] - step.offsets[owner]) * 8 + size])
    return [np.concatenate(x) for x in zip(*out)]


def _gathered(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Totals of the rows of several steps.  Rows of one text stay together, and so pack well."""
    fp, proof, times, mark, place = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(fp)
    same = fp[order[1:]] == fp[order[:-1]]
    if (same & (proof[order[1:]] != proof[order[:-1]])).any():
        order = np.lexsort((proof, fp))
        same = (fp[order[1:]] == fp[order[:-1]]) & (proof[order[1:]] == proof[order[:-1]])
    first = np.flatnonzero(np.append(True, ~same))
    times = np.add.reduceat(times[order], first).astype(np.int32)
    one = order[first]
    by = np.lexsort((place[one], mark[one]))
    one, times = one[by], times[by]
    for k in range(0, len(one), BATCH_ROWS):
        c = one[k:k + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[c].view(np.int64)), pa.array(proof[c]), pa.array(times[k:k + BATCH_ROWS]), pa.array(mark[c]), pa.array(place[c])],
            names=["fp", "proof", "times", "text_hash", "place"])


def _counted(bits: np.ndarray | None, fp_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            seed = seeds(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
            marks = batch.column(2).to_numpy()
            for a, b in steps(batch.column(1), STEP_BYTES):
                rows = _step_rows(Step(batch.column(1).slice(a, b - a), seed[a:b], fp_bits), marks[a:b], bits)
                if parts and sum(len(x[0]) for x in parts) + len(rows[0]) > GATHERED_ROWS:
                    yield from _gathered(parts)
                if len(rows[0]):
                    parts.append(rows)
            give_back()
        if parts:
            yield from _gathered(parts)
        give_back()

    return run


def _merged(least: int):
    """Totals of rows sorted by fingerprint, for fingerprints of ``least`` or more and for empty phrases."""
    def batch_of(fp, f, mixed, mark, place) -> pa.RecordBatch:
        keep = (f >= least) | (place % 8 == 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (fp, f, mixed, mark, place)],
                                          names=["fp", "f", "mixed", "text_hash", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None            # the last fingerprint of the batches before: it may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, proof, times, mark, place = (batch.column(k).to_numpy() for k in range(5))
            first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
            low, high = np.minimum.reduceat(proof, first), np.maximum.reduceat(proof, first)
            now = [fp[first], np.add.reduceat(times.astype(np.int64), first), low, high, mark[first], place[first]]
            if carry is not None:
                if carry[0][0] == now[0][0]:
                    now[1][0] += carry[1][0]
                    now[2][0], now[3][0] = min(now[2][0], carry[2][0]), max(now[3][0], carry[3][0])
                else:
                    now = [np.concatenate(x) for x in zip(carry, now)]
            carry = [x[-1:].copy() for x in now]
            fp, f, low, high, mark, place = (x[:-1] for x in now)
            yield batch_of(fp, f, low != high, mark, place)
        if carry is not None:
            fp, f, low, high, mark, place = carry
            yield batch_of(fp, f, low != high, mark, place)
        give_back()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text.alias("text")) \
        .where("text <> ''").withColumn("text_hash", F.xxhash64("text"))


def frequent(texts: DataFrame, least: int, bits: np.ndarray | None = None, fp_bits: int = 64) -> DataFrame:
    """fp, f and a pointer of every phrase that occurs ``least`` times: words and pairs, or with ``bits`` longer
    ones; and the empty phrases."""
    counted = texts.select("lang", "text", "text_hash").mapInArrow(_counted(bits, fp_bits), COUNTED)
    sorted_ = counted.repartition("fp").sortWithinPartitions("fp")
    found = write_table(sorted_.mapInArrow(_merged(least), TOTALS), "fingerprints")
    mixed = found.where("mixed").select("fp")
    if not mixed.isEmpty():
        apart = counted.join(mixed, "fp", "left_semi").groupBy("fp", "proof") \
            .agg(F.sum("times").alias("f"), F.first("text_hash").alias("text_hash"), F.first("place").alias("place")) \
            .where((F.col("f") >= least) | (F.col("place") % 8 == 0))
        found = write_table(found.where("not mixed").drop("mixed").unionByName(apart.drop("proof")), "fingerprints")
    return found.select("fp", "f", "text_hash", "place")


def pair_bits(found: DataFrame) -> np.ndarray:
    """Bitmap of the frequent pairs' fingerprints: 2**FILTER_BITS bits, whatever their number."""
    slots = found.where("place % 8 = 2").select(F.shiftrightunsigned("fp", 64 - FILTER_BITS).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def _words_from(raw: bytes, at: int, size: int) -> list[bytes]:
    """The ``size`` words that begin at ``at``."""
    width = 64 * (size + 1)
    while True:
        words = raw[at:at + width].split(None, size)
        if len(words) > size or at + width >= len(raw):
            return words[:size]
        width *= 4


def _polynomials(words: list[list[bytes]], size: int) -> np.ndarray:
    """Polynomials of phrases of ``size`` words."""
    distinct = sorted({w for phrase in words for w in phrase})
    number = {w: k for k, w in enumerate(distinct)}
    h = hash_words([w.decode() for w in distinct])
    codes = np.array([[number[w] for w in phrase] for phrase in words], np.int64).reshape(len(words), size)
    out, power = np.zeros(len(words), np.uint64), 1
    for k in range(size):
        out += h[codes[:, k]] * np.uint64(power)
        power = power * INVERSE % (1 << 64)
    return out


def _read_back(batches: Iterator[pa.RecordBatch], fp_bits: int) -> Iterator[pa.RecordBatch]:
    """Phrases that the pointers of each text point at, if they give the pointer's fingerprint."""
    _, plain = _byte_tables()
    for batch in batches:
        found: dict[int, list[tuple]] = {}
        for lang, text, pointers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = plain[np.frombuffer(text.encode(), np.uint8)].tobytes()
            for p in pointers:
                size = p["place"] % 8
                words = _words_from(raw, p["place"] // 8, size)
                if len(words) == size:
                    found.setdefault(size, []).append((lang, words, p["fp"], p["f"]))
        for size, rows in found.items():
            langs, words, fps, fs = zip(*rows)
            coded = pa.array(langs, pa.string()).dictionary_encode()
            seed = seeds(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            good = np.flatnonzero(fingerprint(_polynomials(list(words), size), seed, size, fp_bits).view(np.int64) == np.array(fps, np.int64)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[k] for k in good], pa.string()), pa.array(np.full(len(good), size, np.int32)),
                 pa.array([b" ".join(words[k]).decode() for k in good], pa.string()), pa.array([fs[k] for k in good], pa.int64())],
                names=["lang", "size", "phrase", "f"])
        give_back()


def phrase_counts(docs: DataFrame, least: int = LEAST, fp_bits: int = 64) -> DataFrame:
    """lang, size, phrase, f of every phrase of one to four words that occurs ``least`` times in its language; the
    empty phrase (size 0) has the number of words.  ``fp_bits``: bits of a fingerprint (fewer in tests)."""
    texts = _texts(docs)
    short = frequent(texts, least, None, fp_bits)
    found = short.unionByName(frequent(texts, least, pair_bits(short), fp_bits))
    pointers = found.groupBy("text_hash").agg(F.collect_list(F.struct("fp", "f", "place")).alias("pointers"))
    read = texts.join(write_table(pointers, "pointers"), "text_hash").select("lang", "text", "pointers") \
        .mapInArrow(lambda batches: _read_back(batches, fp_bits), "lang string, size int, phrase string, f long")
    # a text that occurs again gives its phrases again
    return write_table(read.groupBy("lang", "size", "phrase").agg(F.max("f").alias("f")), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what spaces and tabs separate (A-Z in lower case) within pieces, which ``.,;:!?`` and line
    ends separate.  a, l and r are the occurrences of the phrase, of its first and of its second part
    at the cut of the lowest score floor(2000000 * a / (l + r)) (ties: the earliest cut), n those of
    all words of the language.  A phrase inside a longer one of 80 % of its occurrences is left out.
    Order: score, a (descending), phrase (bytes).  A null lang is ``und``; null and empty texts
    have no words; other columns, doc_id among them, are not read, and repeated rows count each time.
    """
    known = phrase_counts(docs, least)
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = known.where("size > 2").select("lang", "f", F.explode(inner).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = known.where("size > 1").join(longer, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("f"))).withColumnRenamed("f", "a")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w")) \
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
                F.array_join(F.slice("w", F.col("k") + 1, LONGEST), " ").alias("rest"))
    parts = known.where("size between 1 and 3")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]) \
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(19, 0)) * {SCALE} div (l + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    total = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
