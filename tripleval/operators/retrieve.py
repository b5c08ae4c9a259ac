"""The token answerer: an impact-ordered inverted index of train rows, searched with early termination.

A train row answers a validation row by the distinct tokens they share: a token on df train rows weighs
floor(10^9 / df), and the score is floor(1000 * summed weights / distinct tokens of the train row).  The
part of one token, 1000 * weight / tokens of the row, is its impact there; a token's list is ordered by
impact, that is, by the size of its rows.

Tokens travel as ints, their numbers: the most frequent is 0, so a token's weight follows from the few numbers at
which the weight changes (``steps``).  Train rows of equal token sets are one row of the index, under the lowest id.

The rows are dealt to blocks of about ``BLOCK`` postings and the validation rows to parts of about ``PART``.  Both are
shuffled once; every block meets every part in a cross join, which reads them where they are, and a task inverts the
block in memory and reads the part as a stream.  So what is written grows with the rows, not with blocks times parts.  A
task gives the best row of its block for each validation row, and the best of these is taken.

Search of a block (MaxScore):

1. Per validation row, the tokens that the block knows, from the rarest on; each knows the summed weights of the tokens
   from it on.  The best impact of all lists of the index is a first threshold.
2. The first ``PIECE`` rows of the lists of the rarest tokens, down to the share ``FIRST`` of all weights of the row, are
   read as in 3.  The best score by the tokens seen there is a better threshold; any lower bound would do.
3. A list is read as far as its token and all after it, no more of them than the row has tokens, could give a row of
   that size the share ``LEFT`` of the threshold.  Whole lists of frequent tokens stay closed, and others are read for
   small rows only.
4. What a row has not been read for is less than that share, so the winner has the other part of the threshold
   from what was read.  The few rows that have are scored in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .joins import checked_join, gathered, runs_of
from .numbering import rank_global

KEY = ["distribution", "example_id"]
WEIGHT_UNIT = 1_000_000_000
SCORE_UNIT = 1000
# More tokens than a row may have, and the bits of a row's place below a token's number.
LARGEST = 1 << 26
PLACE_BITS = 32
# Share of the threshold that may be left unread, and the rows of a piece of a list.
LEFT = 0.6
PIECE = 64
# The first reading leaves the lists whose weights from there on are below this share of the row's.
FIRST = 0.3
# Postings of a block of train rows, and rows and tokens of a part of the validation rows, about; they bound a task.
BLOCK = 16_000_000
PART = 25_000
PART_TOKENS = 4_000_000
# Rows of an Arrow batch worked on at a time, and the postings or tokens held for them.
STEP = 256
HELD = 1 << 20
# Bounds are floating-point sums: they get this much slack.
SLACK = 1 + 1e-9
# Bytes of text whose tokens are cut out at a time, and those that tokens are made of (``ROUGE_TOKEN``).
TEXT_BYTES = 4 << 20
_TOKEN_BYTE = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
_ID_SHIFT = Decimal(1 << 63)
_ID_RANGE = Decimal(1 << 64)


def _best(score: Column, row_id: Column) -> Column:
    """The largest (score, -id) of a group as one decimal, which a hash aggregate can hold."""
    return F.max(score.cast("decimal(18,0)") * F.lit(_ID_RANGE) - (row_id.cast("decimal(20,0)") + F.lit(_ID_SHIFT)))


def _unpacked(best: Column) -> tuple[Column, Column]:
    """(score, id) of ``_best``."""
    score = F.ceil(best / F.lit(_ID_RANGE)).cast("decimal(18,0)")
    return score.cast("long"), (score * F.lit(_ID_RANGE) - best - F.lit(_ID_SHIFT)).cast("long")


def _lists_of_texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Lower-cased texts, in steps -> (first row of the step, row and place in the dictionary of each distinct token of a
    row, sorted, and the dictionary).  The bytes of all tokens of a step are cut out at once."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + TEXT_BYTES, side="right")) - 1)
        begins = bounds[start:stop] - bounds[start]
        n = bounds[stop] - bounds[start]
        data = np.frombuffer(texts.buffers()[2], np.uint8, n, bounds[start]) if n else np.zeros(0, np.uint8)
        inside = _TOKEN_BYTE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins_in = begins[begins < n]
        first[begins_in] |= inside[begins_in]
        at = np.flatnonzero(first)
        kept = data[inside]
        offsets = np.append(np.cumsum(inside)[at] - 1, len(kept)).astype(np.int64)
        tokens = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
        row = np.searchsorted(begins, at, side="right") - 1
        # of empty texts and the one after them, which begin at one place, the last one is found
        pairs = np.sort(row * max(1, len(tokens.dictionary)) + tokens.indices.to_numpy())
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        yield start, *np.divmod(pairs, max(1, len(tokens.dictionary))), tokens.dictionary.cast(pa.string())
        start = stop


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct tokens of ``observations``, with a number of their row."""
    cols = rows.select(*keys, F.monotonically_increasing_id().alias("_row"), F.lower("observations").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, row, code, dictionary in _lists_of_texts(batch.column(len(keys) + 1)):
                sizes = np.bincount(row).astype(np.int32)
                for part in (slice(k, k + HELD) for k in range(0, len(row), HELD)):
                    at = pa.array(row[part] + start)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys) + 1)), pa.array(sizes[row[part]]),
                                                      dictionary.take(pa.array(code[part]))], names=[*keys, "_row", "size", "token"])

    schema = T.StructType([*(cols.schema[k] for k in [*keys, "_row"]), T.StructField("size", T.IntegerType()), T.StructField("token", T.StringType())])
    return cols.mapInArrow(run, schema)


def _counted(rows: DataFrame) -> DataFrame:
    """(token, df, least): the rows that have a token in ``observations``, and the size of the smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, code, dictionary in _lists_of_texts(batch.column(0)):
                least = np.full(len(dictionary), LARGEST, np.int64)
                np.minimum.at(least, code, np.bincount(row)[row])
                yield pa.RecordBatch.from_arrays([dictionary, pa.array(np.bincount(code, minlength=len(dictionary))), pa.array(least)], names=["token", "df", "least"])

    counts = rows.select(F.lower("observations").alias("text")).mapInArrow(run, "token string, df long, least long")
    return counts.groupBy("token").agg(F.sum("df").alias("df"), F.min("least").alias("least"))


def _largest_rows(weight: np.ndarray, end: np.ndarray, goal: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Per list, the size of the largest row to which its token and all after it (descending weights, up to ``end``)
    could give a mean of ``goal``.  A row holds no more of these tokens than its size, and the mean of the heaviest
    falls as more are taken, so the size is searched for by halving; past the last token, their sum bounds it.
    ``at``: the places of the lists in ``weight``, by default all."""
    total = np.concatenate([[0], np.cumsum(weight)])
    at = np.arange(len(weight)) if at is None else at
    low, high = np.zeros_like(at), end - at
    while (low < high).any():
        mid = (low + high + 1) // 2
        enough = (total[at + mid] - total[at]) * SLACK >= goal * mid
        low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
    with np.errstate(divide="ignore"):
        all_of = np.minimum((total[end] - total[at]) / goal * SLACK, LARGEST).astype(np.int64)
    return np.where(low == end - at, all_of, low)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _held(counts: np.ndarray) -> Iterator[slice]:
    """Consecutive parts of ``counts`` that sum up to at most ``HELD`` each, or one of them."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - counts[start] + HELD, side="right")))
        yield slice(start, stop)
        start = stop


class _Block:
    """Train rows by size, then id, and their inverted lists: one sorted array of number above place of the row."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray):
        order = np.lexsort((ids, sizes))
        self.sizes, self.ids, self.counts, self.numbers = sizes[order], ids[order], counts[order], numbers
        self.starts = (np.cumsum(counts) - counts)[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.lists = numbers.astype(np.int64)
        self.lists <<= PLACE_BITS
        self.lists |= np.repeat(place, counts)
        self.lists.sort()

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The rows of postings."""
        return self.lists[at] & ((1 << PLACE_BITS) - 1)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The places of ``keys`` in the lists; looked up in their order, which reads memory in its order."""
        order = np.argsort(keys)
        out = np.empty(len(keys), np.int64)
        out[order] = np.searchsorted(self.lists, keys[order])
        return out

    def shared(self, own: np.ndarray, rows: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Per pair of a validation row and a row, the summed weights of the tokens of the one that the other has;
        ``keys``, ascending, and ``weight`` are those of the tokens of the validation rows (``_token_keys``)."""
        out = np.zeros(len(rows), np.int64)
        for part in _held(self.counts[rows]):
            counts = self.counts[rows[part]]
            token = _token_keys(np.repeat(own[part], counts), self.numbers[_ragged(self.starts[rows[part]], counts)])
            at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
            total = np.concatenate([[0], np.cumsum(np.where(keys[at] == token, weight[at], 0))])
            out[part] = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        return out


def _token_keys(own: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(validation row, token) as one number, which ascends as the tokens of a row get more frequent."""
    return (own.astype(np.int64) << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - number.astype(np.int64))


class _Opened:
    """The lists of a block that some validation rows may read, rarest token first, under given thresholds.  No list is
    read whose token weighs less than the mean it would have to give; such lists are not looked up, they only count
    with their weights."""

    def __init__(self, block: _Block, own: np.ndarray, number: np.ndarray, weight: np.ndarray, threshold: np.ndarray):
        may = np.flatnonzero(weight * SLACK >= LEFT * threshold[own] / SCORE_UNIT)
        start = block.places(number[may].astype(np.int64) << PLACE_BITS)
        known = block.lists[np.minimum(start, len(block.lists) - 1)] >> PLACE_BITS == number[may]
        kept = np.ones(len(own), bool)
        kept[may[~known]] = False
        self.block, self.n = block, len(threshold)
        self.own, self.weight = own[kept], weight[kept]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.own, minlength=self.n))])
        self.total = np.concatenate([[0], np.cumsum(self.weight)])
        self.at = (np.cumsum(kept) - 1)[may[known]]
        self.number, self.start = number[may[known]].astype(np.int64), start[known]
        self.least = block.sizes[block.rows(self.start)]

    def read(self, threshold: np.ndarray, share: float = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, first posting, postings) of the lists that are read, each up to the largest row it is read for.  Lists
        are left from where their weights sum up to less than ``share`` of the validation row's."""
        own = self.own[self.at]
        end = self.bounds[1:][own]
        largest = _largest_rows(self.weight, end, LEFT * threshold[own] / SCORE_UNIT, self.at)
        rest = self.total[end] - self.total[self.at]
        k = np.flatnonzero((self.least <= largest) & (rest >= share * np.diff(self.total[self.bounds])[own]))
        stop = np.searchsorted(self.block.sizes, largest[k], side="right")
        counts = self.block.places((self.number[k] << PLACE_BITS) | stop) - self.start[k]
        return self.at[k], self.start[k], counts

    def first(self, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, start, counts = self.read(threshold, FIRST)
        return at, start, np.minimum(counts, PIECE)

    def _seen(self, at: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(validation row, row, the weights by which they meet) from the given postings."""
        pair = np.repeat(self.own[at], counts) * len(self.block.sizes) + self.block.rows(_ragged(start, counts))
        order = np.argsort(pair)
        pair = pair[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        seen = np.add.reduceat(np.repeat(self.weight[at], counts)[order], heads) if len(pair) else np.zeros(0, np.int64)
        return pair[heads] // len(self.block.sizes), pair[heads] % len(self.block.sizes), seen

    def better(self, threshold: np.ndarray) -> np.ndarray:
        """The thresholds, raised to the best score by the tokens seen in a first reading."""
        own, rows, seen = self._seen(*self.first(threshold))
        out = threshold.copy()
        np.maximum.at(out, own, seen * SCORE_UNIT // self.block.sizes[rows])
        return out

    def close(self, threshold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(validation row, row of the block) of the pairs that can reach the threshold by what was read."""
        at, start, counts = self.read(threshold)
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.own[at], minlength=self.n))])
        reads = np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])
        many = 16 * reads >= len(self.block.sizes)
        few = np.flatnonzero(~many[self.own[at]])
        by_row = np.flatnonzero(~many & (reads > 0))
        found = []
        for part in _held(reads[by_row]):
            of = few[np.searchsorted(self.own[at[few]], by_row[part.start]):np.searchsorted(self.own[at[few]], by_row[part.stop - 1], side="right")]
            found.append(self._seen(at[of], start[of], counts[of]))
        for q in np.flatnonzero(many & (reads > 0)):
            of = slice(ends[q], ends[q + 1])
            seen = np.zeros(len(self.block.sizes))
            for part in _held(counts[of]):
                of_part = slice(of.start + part.start, of.start + part.stop)
                seen += np.bincount(self.block.rows(_ragged(start[of_part], counts[of_part])),
                                    np.repeat(self.weight[at[of_part]], counts[of_part]), len(seen))
            rows = np.flatnonzero(seen)
            found.append((np.full(len(rows), q), rows, seen[rows]))
        for own, rows, seen in found:
            near = SCORE_UNIT * seen * SLACK >= threshold[own] * (1 - LEFT) * self.block.sizes[rows]
            if near.any():
                yield own[near], rows[near]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.RecordBatch]]:
    """(cell, query, ...) sorted by these -> the block of a cell with the validation rows of its part, a step at a time."""
    cell, block, parts = None, None, []
    for batch in batches:
        key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if key[lo] // 2 != cell:
                cell, block, parts = key[lo] // 2, None, []
            rows = batch.slice(lo, hi - lo)
            if key[lo] % 2 == 0:
                numbers = rows.column("numbers")
                parts.append([rows.column("size").to_numpy().copy(), rows.column("id").to_numpy().copy(),
                              numbers.value_lengths().to_numpy().astype(np.int64), numbers.flatten().to_numpy().copy()])
                continue
            if parts:
                columns, parts = [np.concatenate(x) for x in zip(*parts)], []
                block = _Block(*columns)
            for k in range(0, len(rows) if block else 0, STEP):
                yield block, rows.slice(k, STEP)


def _lists_of(block: _Block, rows: pa.RecordBatch, steps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Opened]:
    """Tokens of validation rows (row, number, weight) and the lists of the block for them."""
    numbers = rows.column("numbers")
    own = np.repeat(np.arange(len(rows)), numbers.value_lengths().to_numpy())
    number = numbers.flatten().to_numpy()
    weight = steps[1][np.searchsorted(steps[0], number)]
    return own, number, weight, _Opened(block, own, number, weight, rows.column("threshold").to_numpy())


def _best_rows(steps: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells -> (distribution, example_id, train_id, score): the best row of the block, if it can be the best of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _cells(batches):
            own, number, weight, opened = _lists_of(block, rows, steps)
            threshold = opened.better(rows.column("threshold").to_numpy())
            keys = _token_keys(own, number)
            best = [np.zeros((3, 0), np.int64)]
            for q, close in opened.close(threshold):
                score = block.shared(q, close, keys, weight) * SCORE_UNIT // block.sizes[close]
                reached = score >= threshold[q]
                best.append(np.stack([q[reached], block.ids[close[reached]], score[reached]]))
            q, train_id, score = np.concatenate(best, axis=1)
            order = np.lexsort((train_id, -score, q))
            at = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(q[at])) for k in KEY), pa.array(train_id[at]), pa.array(score[at])],
                                             names=[*KEY, "train_id", "score"])
    return run


def _postings_read(steps: tuple[np.ndarray, np.ndarray], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells -> (distribution, example_id, weight, train_id): the postings of the first or of the second reading."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _cells(batches):
            opened = _lists_of(block, rows, steps)[-1]
            threshold = rows.column("threshold").to_numpy()
            at, start, counts = opened.first(threshold) if first else opened.read(opened.better(threshold))
            for part in _held(counts):
                own = pa.array(np.repeat(opened.own[at[part]], counts[part]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(own) for c in KEY), pa.array(np.repeat(opened.weight[at[part]], counts[part])),
                                                  pa.array(block.ids[block.rows(_ragged(start[part], counts[part]))])], names=[*KEY, "weight", "train_id"])
    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of train rows -> (number, first, entries): the lists of the blocks in pieces.  The first piece of a list is
    the one with ``first``."""
    for block, _ in _cells(batches):
        number = block.lists >> PLACE_BITS
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        place = np.arange(len(number)) - np.repeat(heads, np.diff(np.append(heads, len(number))))
        starts = np.flatnonzero(place % PIECE == 0)
        entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(number)), pa.int32()), pa.array(block.ids[block.rows(np.arange(len(number)))]))
        yield pa.RecordBatch.from_arrays([pa.array(number[starts], pa.int32()), pa.array(place[starts] == 0), entries], names=["number", "first", "entries"])


@dataclass
class AnswerIndex:
    tokens: DataFrame     # (token, number, df, least): per train token the size of its smallest row
    rows: DataFrame       # (size, train_id, numbers): the tokens of train rows
    answers: DataFrame    # (train_id, answer)

    def query_rows(self, inputs: DataFrame) -> DataFrame:
        """Known tokens of each validation row, the rarest first, and the best impact of their lists."""
        known = self.tokens.select("token", F.struct("number", F.expr(f"{SCORE_UNIT} * ({WEIGHT_UNIT} div df) div least").alias("impact")).alias("t"),
                                   F.col("df").alias("_df"))
        runs = runs_of(checked_join(_exploded(inputs, *KEY), known, ["token"], count="_df"), KEY, "t", "_row")
        rows = runs.select(*KEY, F.array_max("t.impact").alias("impact"), F.col("t.number").alias("numbers")) \
            .groupBy(*KEY).agg(F.max("impact").alias("threshold"), F.flatten(F.collect_list("numbers")).alias("numbers"))
        return write_table(rows.select(*KEY, "threshold", F.sort_array(F.array_distinct("numbers"), asc=False).alias("numbers")), "query-rows", codec="zstd")

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """(last number, weight) of the tokens of each df, by number.  There are less than sqrt(2 * postings) of them."""
        of = self.tokens.groupBy("df").agg(F.max("number").alias("last")).collect()
        of = sorted((r["last"], WEIGHT_UNIT // r["df"]) for r in of)
        return np.array([x for x, _ in of], np.int32), np.array([w for _, w in of], np.int64)

    def cells(self, queries: DataFrame) -> DataFrame:
        """Every block of train rows with every part of ``queries``: one cell each, its train rows first.  Blocks and
        parts are shuffled once, a row each, and meet in a cross join, whose tasks read them from there."""
        blocks = -(-(self.rows.agg(F.sum(F.size("numbers"))).first()[0] or 1) // BLOCK)
        asked, tokens = queries.agg(F.count(F.lit(1)), F.sum(F.size("numbers"))).first()
        parts = max(1, -(-asked // PART), -(-(tokens or 0) // PART_TOKENS))
        none = F.lit(None)
        keys = [none.cast(queries.schema[c].dataType).alias(c) for c in [*KEY, "threshold"]]
        train = F.struct(F.lit(False).alias("query"), F.col("size").cast("long").alias("size"), F.col("train_id").alias("id"), *keys, "numbers")
        query = F.struct(F.lit(True).alias("query"), none.cast("long").alias("size"), none.cast("long").alias("id"), *KEY, "threshold", "numbers")
        def dealt(rows: DataFrame, n: int, by: Sequence[str], row: Column, number: str, name: str) -> DataFrame:
            of = rows.select(F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias(number), row.alias("row"))
            every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias(number), none.cast(of.schema["row"].dataType).alias("row"))
            return of.unionByName(every).groupBy(number).agg(F.collect_list("row").alias(name)).coalesce(n)
        met = dealt(self.rows.where("train_id IS NOT NULL"), blocks, ["train_id", "size"], train, "_b", "train").hint("shuffle_replicate_nl") \
            .crossJoin(dealt(queries, parts, KEY, query, "_p", "queries"))
        return met.select((F.col("_b") * parts + F.col("_p")).alias("cell"), F.explode(F.concat("train", "queries")).alias("row")).select("cell", "row.*")

    @property
    def pieces(self) -> DataFrame:
        """(number, first, entries): the lists of the blocks, ids of train rows by size, in pieces."""
        one = self.rows.sparkSession.createDataFrame([("", 0, 0, [])], "distribution string, example_id long, threshold long, numbers array<int>")
        return self.cells(one).mapInArrow(_pieces, "number int, first boolean, entries array<long>")

    def search(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings read for a better threshold, and those read with it."""
        cells, steps = self.cells(queries), self.steps()
        schema = T.StructType([*(queries.schema[k] for k in KEY), T.StructField("weight", T.LongType()), T.StructField("train_id", T.LongType())])
        return cells.mapInArrow(_postings_read(steps, True), schema), cells.mapInArrow(_postings_read(steps, False), schema)

    def retrieve(self, inputs: DataFrame) -> DataFrame:
        """distribution, example_id, train_id, score, answer: the train row of the highest score of each validation
        row (ties: the lowest id).  Rows that share no token with any train row are absent."""
        queries = self.query_rows(inputs)
        schema = T.StructType([*(queries.schema[k] for k in KEY), T.StructField("train_id", T.LongType()), T.StructField("score", T.LongType())])
        scores = self.cells(queries).mapInArrow(_best_rows(self.steps()), schema)
        score, train_id = _unpacked(F.col("best"))
        best = scores.groupBy(*KEY).agg(_best(F.col("score"), F.col("train_id")).alias("best")) \
            .select(*KEY, train_id.alias("train_id"), score.alias("score"))
        # one row can be the best of many: heavy ids join map-side
        return checked_join(best, self.answers, ["train_id"]).select(*KEY, "train_id", "score", "answer")

    def work(self, inputs: DataFrame) -> DataFrame:
        """One row: the postings of all lists of all validation rows, and how many of them a search reads."""
        queries = self.query_rows(inputs)
        first, then = self.search(queries)
        read = first.select("weight").unionByName(then.select("weight")).select(F.lit(0).cast("long").alias("df"), F.lit(1).cast("long").alias("read"))
        known = queries.select(F.explode("numbers").alias("number")).join(self.tokens.select("number", "df"), "number")
        return known.select("df", F.lit(0).cast("long").alias("read")).unionByName(read) \
            .agg(F.sum("df").alias("postings"), F.sum("read").alias("postings_read"))


def fit_answerer(train: DataFrame) -> AnswerIndex:
    """Index of the train rows (example_id, observations, response), of which every one can answer."""
    lists = _exploded(train.withColumnRenamed("example_id", "train_id"), "train_id")
    tokens = rank_global(_counted(train).where(f"df <= {WEIGHT_UNIT}"), [F.desc("df"), "token"], start=0, spread_ties=False, stored=True)
    tokens = write_table(tokens.select("token", F.col("rank").cast("int").alias("number"), "df", "least"), "answer-tokens")
    found = checked_join(lists, tokens.select("token", "number", F.col("df").alias("_df")), ["token"], count="_df")
    rows = gathered(found, ["train_id", "size"], "number", "_row")
    rows = rows.groupBy("size", F.sort_array(F.array_distinct("number")).alias("numbers")).agg(F.min("train_id").alias("train_id"))
    rows = write_table(rows.select("size", F.col("train_id").cast("long").alias("train_id"), "numbers"), "answer-rows", codec="zstd")
    answers = train.select(F.col("example_id").alias("train_id"), F.col("response").alias("answer"))
    return AnswerIndex(tokens, rows, answers)
