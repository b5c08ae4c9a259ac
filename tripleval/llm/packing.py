"""Best-fit packing of tokenised documents into fixed-length sequences.

Bound-certified repacking: items are dealt by hash into groups of bounded size; each group is
packed best-fit decreasing and its bin count is compared with a lower bound from dual feasible
functions.  A group that meets its bound is certified and keeps its bins, but for its emptiest
one; a group with a gap keeps only its full bins.  The released documents are dealt anew and
packed again, until one group takes all of them, or a round releases as many documents in no
fewer bins than the round before, whose bins then stand.  There is no limit to the rounds.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .shingles import give_back, steps, word_codes

SEQUENCE = 4096
END_ID = 1
GROUP_ITEMS = 50_000
# A sequence's number: the round, the group (24 bits), the bin (20 bits).
ROUND_SHIFT, GROUP_SHIFT = 44, 20
# Entries (a word and its ids, some 150 bytes) that a worker remembers; beyond it starts anew.
REMEMBERED_WORDS = 600_000
SEEN_SLOTS = 1 << 22
REMEMBERED_CHARS = 64
TEXT_STEP = 2 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, open boolean, bins long, bound long"


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the characters
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def simple_latin(word: str) -> bool:
    """Letters below U+0250 in composed form, whose lower case needs no context."""
    return max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word)


class WordIds:
    """Token ids of words, remembered within one Python worker.

    The pre-tokeniser never joins text across white space, so a document's ids are the ids of its
    white-space separated words in order; Arrow splits and numbers the words, and each distinct
    word is tokenised once.  A word of plain Latin letters is taken in lower case and without a
    closing comma or full stop, which the normaliser lowers and the pre-tokeniser splits off; its
    letters are one pre-token and go to the vocabulary's model directly.  All else goes through
    the whole tokeniser.
    """

    _by_path: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.seen = bytearray(SEEN_SLOTS)

    @classmethod
    def at(cls, path: str) -> WordIds:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _remember(self, word: str, ids: bytes) -> None:
        """Keep a word that was met before; most words are met once."""
        slot = hash(word) & (SEEN_SLOTS - 1)
        if self.seen[slot]:
            if len(word) <= REMEMBERED_CHARS:
                self.known[word] = ids
        else:
            self.seen[slot] = 1

    def _letters(self, low: str) -> bytes:
        """Ids of one run of lower-case letters: the model takes it byte by byte as characters."""
        ids = self.known.get(low)
        if ids is None:
            chars = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()
            self._remember(low, ids)
        return ids

    def ids(self, word: str) -> bytes:
        """Ids of a word without white space ('' has none), as 32-bit numbers."""
        end = word[-1] if word[-1:] in (",", ".") and len(word) > 1 else ""
        core = word[:-1] if end else word
        if core.isalpha() and (core.isascii() or simple_latin(core)):
            ids = self._letters(core.lower())
            if end:
                ids = ids + (self.known.get(end) or self.ids(end))
            elif word.islower():
                return ids
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self._remember(word, ids)
        return ids

    def encode(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """Ids (32-bit) of each text, a bounded number of bytes at a time (one text at least)."""
        for first, last in steps(texts, TEXT_STEP):
            codes, distinct, counts = word_codes(texts.slice(first, last - first))
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            each = list(map(self.known.get, distinct))
            each = [self.ids(w) if x is None else x for w, x in zip(distinct, each)]
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
            flat = np.frombuffer(b"".join(each), np.uint32)
            begin = np.cumsum(sizes) - sizes
            n = sizes[codes]
            ends = np.cumsum(n)
            at = np.arange(int(n.sum())) + np.repeat(begin[codes] - (ends - n), n)
            ids = flat[at]
            stops = np.concatenate([[0], ends])[np.cumsum(counts)]
            yield from np.split(ids, stops[:-1])


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document (columns ``doc_id``, ``text``; null text: empty): its token ids then ``end_id``, cut every
    ``limit`` ids.  Columns: doc_id, piece, start, length, ids_crc32.  Other columns are ignored."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, tokens in zip(ids, words.encode(batch.column(1))):
                view = memoryview(tokens.tobytes() + end)
                n = len(view) // 4
                for piece, s in enumerate(range(0, n, limit)):
                    e = min(n, s + limit)
                    rows.append((doc_id, piece, s, e - s, zlib.crc32(view[4 * s:4 * e])))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions: the plain sum, the threshold
    functions (items above capacity - e count whole, those below e not at all) for every e, and
    the rounding functions floor((k + 1) x / capacity) / k."""
    if not len(lengths):
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    best = -(-int((count * x).sum()) // capacity)
    cum_n, cum_x = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    whole = cum_n[capacity] - cum_n[capacity - e]
    middle = cum_x[capacity - e] - cum_x[e - 1]
    best = max(best, int((whole - (-middle // capacity)).max()))
    for k in range(1, 61):
        v = (k + 1) * x
        scaled = np.where(v % capacity == 0, x * k, (v // capacity) * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin; items are taken in the given order.

    Open bins are kept by free space; a bit per free space finds the tightest one in a few steps.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, fill = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = free_bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_bits &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if free - n:
            by_free[free - n].append(b)
            free_bits |= 1 << (free - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack_group(capacity: int, round_no: int, last: bool):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                                  kind="stable").reset_index(drop=True)
        lengths = items["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        released = np.zeros(len(fill), bool)
        if not last:
            if len(fill) > bound:
                released = fill < capacity
            elif fill.min() < capacity:
                released[int(fill.argmin())] = True
        out = items[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (round_no << ROUND_SHIFT) + (int(key[0]) << GROUP_SHIFT) + bins
        out["offset"] = offsets
        out["open"] = released[bins]
        out["bins"], out["bound"] = len(fill), bound
        return out
    return run


def pack(items: DataFrame, capacity: int = SEQUENCE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Sequences for the pieces of ``token_pieces``: adds ``sequence_id`` and ``offset`` (gapless
    from 0), and of the group that placed the piece its ``bins`` and certified lower ``bound``.

    ``items`` is read more than once: pass a written table.  Repeated rows are separate items; an
    empty table gives an empty result.  Every round is written to the shared folder, so a lost
    executor repeats tasks of one round only.
    """
    done, n, bins, r = None, items.count(), None, 0
    while True:
        groups = max(1, -(-n // group_items))
        last = groups == 1
        salt = F.xxhash64(F.lit(r), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
        dealt = items.withColumn("_group", F.pmod(salt, F.lit(groups)).cast("long"))
        packed = write_table(dealt.groupBy("_group").applyInPandas(_pack_group(capacity, r, last), PACKED),
                             f"pack-{r}")
        left = packed.where("open")
        released, opened = left.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if bins is not None and released == n and opened >= bins:
            # nothing gained: the round before packed the same items as well
            return done.unionByName(before)
        kept = packed.where(~F.col("open")).drop("open")
        done = kept if done is None else done.unionByName(kept)
        if released == 0:
            return done
        before = left.drop("open")
        items, n, bins, r = before.select("doc_id", "piece", "start", "length", "ids_crc32"), released, opened, r + 1
