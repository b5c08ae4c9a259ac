"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the smallest hash among
its ``GRAM``-word grams; consecutive windows that share it form a super-k-mer.  Equal windows have
equal minimisers.  First the minimisers alone travel, five bytes each, and those that only one
super-k-mer of the corpus has are out.  The words of the other super-k-mers travel once, packed,
to the bucket of the minimiser, which so sees all copies of its windows and decides exactly, by
sorting them.

Hot grams (a licence line, a passage that a third of all documents share) rank last as
minimisers, and a window of hot grams alone goes to the bucket of its own hash, so that no bucket
is hot.  The list of hot grams is bounded by the inverse of the share that makes a gram hot.
What a step of documents can settle by itself does not travel: a minimiser goes once per step,
and of equal super-k-mers the earliest; the others are repeated for certain.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .shingles import give_back, gram_hashes, hash_words, mix64, steps, word_codes

WINDOW = 20
GRAM = 5
STEP_BYTES = 10 << 20
# Words of text per bucket; a bucket's windows are those of as many words, if all are repeated.
BUCKET_WORDS = 500_000
KEY_WORDS = 8_000_000
KEY_BITS = 40
HOT_SHARE = 1 / 20_000
HOT_LEAST = 16
NULL_ID = -(1 << 63)

TOP = np.uint64(1 << 63)
MULTIPLIER = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Step:
    """Words of some texts and, per window start, the minimiser's key."""

    def __init__(self, texts: pa.StringArray):
        self.codes, self.distinct, self.counts = word_codes(texts)
        self.hashes = hash_words(self.distinct)[self.codes]
        self.owner = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.begin = np.cumsum(self.counts) - self.counts

    def inside(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each start belong to one text."""
        n = len(self.owner) - size + 1
        return self.owner[:n] == self.owner[size - 1:] if n > 0 else np.empty(0, bool)

    def ranks(self, hot: np.ndarray, gram: int) -> np.ndarray:
        """Rank of every gram as a minimiser."""
        low = gram_hashes(self.hashes, gram)
        rank = low >> np.uint64(1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, low), len(hot) - 1)
            rank[hot[at] == low] |= TOP
        return rank

    def runs(self, hot: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Super-k-mers: first word, windows, key, and whether one may hold a window twice."""
        n = len(self.codes) - window + 1
        valid = self.inside(window)
        if not valid.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        rank = self.ranks(hot, gram)
        span, width, best = window - gram + 1, 1, rank
        while 2 * width <= span:
            best = np.minimum(best[:len(best) - width], best[width:])
            width *= 2
        key = np.minimum(best[:n], best[span - width:span - width + n])
        del best
        if len(hot) and (only := key >= TOP).any():
            key = np.where(only, gram_hashes(self.hashes, window) | TOP, key)
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | first[1:]
        at = np.flatnonzero(first)
        runs = np.flatnonzero(last) - at + 1
        key = key[at]
        # equal windows of one run hold its minimiser at two places
        sizes = runs + span - 1
        place = _ragged(at, sizes)
        times = np.add.reduceat((rank[place] == np.repeat(key, sizes)).astype(np.int32), np.cumsum(sizes) - sizes)
        return at, runs, key, (times > 1) | ((key >= TOP) & (runs > 1))


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and powers for hashing any range of words: range (s, e) hashes to
    (sums[e] - sums[s]) * powers[s]."""
    sums = np.full(len(h) + 1, INVERSE, np.uint64)
    sums[0] = 1
    np.cumprod(sums, out=sums)
    sums[1:] = sums[:-1] * h
    sums[0] = 0
    np.cumsum(sums, out=sums)
    powers = np.full(len(h) + 1, MULTIPLIER, np.uint64)
    powers[0] = 1
    return sums, np.cumprod(powers, out=powers)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _range_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the words starts[i] .. starts[i] + sizes[i] - 1 of each i."""
    sums, up = _prefix(h)
    return (sums[starts + sizes] - sums[starts]) * up[starts]


def _pack_runs(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, runs: np.ndarray, codes: np.ndarray,
               distinct: list[str], zip_: zstandard.ZstdCompressor) -> bytes:
    """Super-k-mers as one compressed string: ids, text marks, starts, window counts, then the words by
    numbers into their own list of distinct words."""
    used, own = np.unique(codes, return_inverse=True)
    names = " ".join([distinct[c] for c in used.tolist()]).encode()
    planes = own.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zip_.compress(b"".join([struct.pack("<BQQQ", 1, len(ids), len(own), len(names)), ids.tobytes(), marks.tobytes(),
                                   starts.tobytes(), runs.tobytes(), planes, names]))


def _pack_spans(spans: list[np.ndarray], zip_: zstandard.ZstdCompressor) -> bytes:
    return zip_.compress(struct.pack("<BQQQ", 0, len(spans[0]), 0, 0) + b"".join(x.tobytes() for x in spans))


def _dealt(deal: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each bucket."""
    if len(deal):
        by = np.argsort(deal, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(deal[by])) + 1):
            yield int(deal[part[0]]), part


def _short(key: np.ndarray) -> np.ndarray:
    """The part of a key that travels: a chance meeting only sends a super-k-mer that need not go."""
    return mix64(key) >> np.uint64(64 - KEY_BITS)


def _deal(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _minimisers(step: Step, ids: np.ndarray, marks: np.ndarray, hot: np.ndarray, buckets: int, window: int, gram: int,
                zip_: zstandard.ZstdCompressor) -> Iterator[tuple[int, bytes]]:
    """Per bucket: the keys with one run in the step (they ask), the keys with more (they tell), and the
    documents and keys that the step settles itself."""
    at, _, key, twice = step.runs(hot, window, gram)
    if not len(at):
        return
    short = _short(key)
    doc = step.owner[at].astype(np.int64)
    distinct, first, group, n = np.unique(short, return_index=True, return_inverse=True, return_counts=True)
    many = n > 1
    many[group[twice]] = True
    asks = first[~many]
    asks = asks[np.argsort(asks)]
    pieces: dict[int, list[bytes]] = {}
    for bucket, part in _dealt(_deal(short[asks], buckets)):
        pieces.setdefault(bucket, [b"", b"", b""])[0] = _pack_asks(short[asks[part]], doc[asks[part]], ids, marks)
    tells = distinct[many]
    for bucket, part in _dealt(_deal(tells, buckets)):
        pieces.setdefault(bucket, [b"", b"", b""])[1] = tells[part].tobytes()
    own = np.flatnonzero(many[group])
    for bucket, part in _dealt(_deal(ids[doc[own]].view(np.uint64), buckets)):
        pieces.setdefault(bucket, [b"", b"", b""])[2] = _pack_asks(short[own[part]], doc[own[part]], ids, marks)
    for bucket, (a, t, o) in pieces.items():
        yield bucket, zip_.compress(struct.pack("<QQQ", len(a), len(t), len(o)) + a + t + o)


def _pack_asks(short: np.ndarray, doc: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> bytes:
    """Keys with their documents: a list of documents, then per key the step to its document and five bytes."""
    used, own = np.unique(doc, return_inverse=True)
    order = np.argsort(own, kind="stable")
    own, short = own[order], short[order]
    gap = np.diff(own, prepend=0).astype(np.uint32)
    planes = np.ascontiguousarray(short).view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].T
    return b"".join([struct.pack("<QQ", len(used), len(own)), ids[used].tobytes(), marks[used].tobytes(), gap.tobytes(),
                     np.ascontiguousarray(planes).tobytes()])


def _unpack_asks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark, key) of each."""
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    docs, n = struct.unpack_from("<QQ", raw)
    ids, marks = np.frombuffer(raw, np.int64, 2 * docs, 16).reshape(2, docs)
    at = 16 + 16 * docs
    own = np.cumsum(np.frombuffer(raw, np.uint32, n, at).astype(np.int64))
    key = np.zeros((n, 8), np.uint8)
    key[:, :KEY_BITS // 8] = np.frombuffer(raw, np.uint8, n * KEY_BITS // 8, at + 4 * n).reshape(KEY_BITS // 8, n).T
    return ids[own], marks[own], key.view(np.uint64).ravel()


def shared_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark, key) of the super-k-mers of a bucket whose key is not alone."""
    unzip = zstandard.ZstdDecompressor()
    asks, tells, own = [], [], []
    for blob in blobs:
        raw = unzip.decompress(blob)
        a, t, o = struct.unpack_from("<QQQ", raw)
        asks.append(_unpack_asks(raw[24:24 + a]))
        tells.append(np.frombuffer(raw, np.uint64, t // 8, 24 + a))
        own.append(_unpack_asks(raw[24 + a + t:24 + a + t + o]))
    ids, marks, key = (np.concatenate(x) for x in zip(*asks))
    told = np.unique(np.concatenate(tells))
    _, group, n = np.unique(key, return_inverse=True, return_counts=True)
    keep = (n[group] > 1) | np.isin(key, told)
    return tuple(np.concatenate([x[keep], *y]) for x, y in zip((ids, marks, key), zip(*own)))


def _super_kmers(step: Step, ids: np.ndarray, marks: np.ndarray, asked: tuple[np.ndarray, np.ndarray], hot: np.ndarray,
                 buckets: int, window: int, gram: int, zip_: zstandard.ZstdCompressor) -> Iterator[tuple[int, bytes]]:
    """Per bucket the packed super-k-mers whose key is among the document's ``asked`` ones (document, key)."""
    at, runs, key, _ = step.runs(hot, window, gram)
    if not len(at):
        return
    doc = step.owner[at].astype(np.int64)
    pair = lambda d, k: mix64(k ^ mix64(d.astype(np.uint64) + np.uint64(1)))
    go = np.isin(pair(doc, _short(key)), pair(*asked))
    at, runs, key, doc = at[go], runs[go], key[go], doc[go]
    if not len(at):
        return
    sizes = runs + window - 1
    start = at - step.begin[doc]
    same, twin = _range_hashes(step.hashes, at, sizes), _range_hashes(mix64(step.hashes), at, sizes)
    order = np.lexsort((start, marks[doc], ids[doc], sizes, twin, same))
    s, t, z = same[order], twin[order], sizes[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    copy, lead = order[~new], leader[~new]
    # a row that repeats id and text is the same document: it goes with its twin
    own = (ids[doc[copy]] == ids[doc[lead]]) & (marks[doc[copy]] == marks[doc[lead]]) & (start[copy] == start[lead])
    copy = copy[~own]
    for bucket, part in _dealt(_deal(ids[doc[copy]].view(np.uint64), buckets)):
        c = copy[part]
        yield bucket, _pack_spans([ids[doc[c]], marks[doc[c]], start[c], start[c] + sizes[c]], zip_)
    sent = np.sort(order[new])
    for bucket, part in _dealt(_deal(key[sent], buckets)):
        c = sent[part]
        codes = step.codes[_ragged(at[c], sizes[c])]
        yield bucket, _pack_runs(ids[doc[c]], marks[doc[c]], start[c], runs[c], codes, step.distinct, zip_)


def _unpack(blobs: list[bytes], window: int) -> tuple[list, list, list[str]]:
    spans, parts, names = [], [], []
    unzip = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = unzip.decompress(blob)
        kind, n, words, size = struct.unpack_from("<BQQQ", raw)
        at = struct.calcsize("<BQQQ")
        cols = np.frombuffer(raw, np.int64, 4 * n, at).reshape(4, n)
        if not kind:
            spans.append(cols)
            continue
        at += 32 * n
        planes = np.frombuffer(raw, np.uint8, 4 * words, at).reshape(4, words)
        own = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        listed = raw[at + 4 * words:at + 4 * words + size].decode().split(" ")
        parts.append((cols, own.astype(np.int64) + len(names)))
        names += listed
    return spans, parts, names


def repeated_spans(blobs: list[bytes], window: int) -> np.ndarray:
    """Columns id, mark, from, to: word ranges covered by windows of a bucket that also start earlier."""
    spans, parts, names = _unpack(blobs, window)
    if not parts:
        return np.concatenate(spans, axis=1) if spans else np.empty((4, 0), np.int64)
    number, distinct = pd.factorize(np.asarray(names, dtype=object))
    cols = np.concatenate([c for c, _ in parts], axis=1)
    words = number[np.concatenate([w for _, w in parts])]
    ids, marks, start, runs = cols
    sizes = runs + window - 1
    at = np.cumsum(sizes) - sizes
    order = np.lexsort((start, marks, ids))  # earliest first
    ids, marks, start, runs, at = ids[order], marks[order], start[order], runs[order], at[order]
    w = _ragged(at, runs)                    # first word of each window
    owner = np.repeat(np.arange(len(runs)), runs)
    step = w - at[owner]
    same = _range_hashes(hash_words(list(distinct))[words], w, np.int64(window))
    by = np.argsort(same, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = same[by][1:] != same[by][:-1]
    lead = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later, lead = by[~new], lead[~new]
    equal = np.ones(len(later), bool)
    for k in range(window):
        equal &= words[w[later] + k] == words[w[lead] + k]
    if not equal.all():                      # different windows of one hash: compare their words
        mixed = np.isin(same, same[later[~equal]])
        seen: dict[bytes, int] = {}
        for x in np.flatnonzero(mixed).tolist():
            lead_x = seen.setdefault(words[w[x]:w[x] + window].tobytes(), x)
            if (where := np.flatnonzero(later == x)).size:
                lead[where], equal[where] = lead_x, lead_x != x
    a, b = owner[later], owner[lead]
    own = (ids[a] == ids[b]) & (marks[a] == marks[b]) & (start[a] + step[later] == start[b] + step[lead])
    gone = np.zeros(len(w) + 1, bool)
    gone[later[equal & ~own]] = True
    gone[-1] = False
    first = gone[:-1].copy()
    first[1:] &= ~gone[:-2] | (owner[1:] != owner[:-1])
    last = gone[:-1].copy()
    last[:-1] &= ~gone[1:-1] | (owner[1:] != owner[:-1])
    f, e = np.flatnonzero(first), np.flatnonzero(last)
    o = owner[f]
    return np.concatenate([*spans, np.stack([ids[o], marks[o], start[o] + step[f], start[o] + step[e] + window])], axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("mark"),
                       text.alias("text"))


def _hot_grams(texts: DataFrame, gram: int, share: float) -> tuple[np.ndarray, int]:
    """The grams above ``share`` of all grams (at most 2 / share of them), and the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            for first, last in steps(col, STEP_BYTES):
                s = Step(col.slice(first, last - first))
                grams = gram_hashes(s.hashes, gram)[s.inside(gram)]
                found, n = np.unique(grams, return_counts=True)
                hot = n >= max(HOT_LEAST, share * len(grams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(found[hot].view(np.int64), 0)), pa.array(np.append(n[hot], 0).astype(np.int64)),
                     pa.array(np.append(np.zeros(hot.sum(), np.int64), len(s.codes)))], names=["gram", "n", "words"])

    counts = texts.select("text").mapInArrow(run, "gram long, n long, words long").groupBy("gram") \
        .agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    counts = write_table(counts, "hot-grams")
    words = counts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()["w"]
    hot = counts.where(F.col("n") >= F.lit(max(HOT_LEAST, share * words / 2))).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in hot], np.int64).view(np.uint64)), words


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of a bounded number of bytes of text (the last column)."""
    for batch in batches:
        for first, last in steps(batch.column(batch.num_columns - 1), STEP_BYTES):
            yield batch.slice(first, last - first)
        give_back()


def _packed(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    out = list(found)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())],
                                         names=["bucket", "packed"])


def removed_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, mark, from_word, to_word: ranges of words to remove; they may overlap.  ``texts`` has doc_id, mark
    (a hash of the text) and text, none null."""
    spark = texts.sparkSession
    hot, words = _hot_grams(texts, gram, hot_share)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_buckets = max(partitions, words // KEY_WORDS)
    buckets = max(2 * partitions, words // BUCKET_WORDS)
    shared = spark.sparkContext.broadcast(hot)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in _steps(batches):
            ids, marks, col = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            yield from _packed(_minimisers(Step(col), ids, marks, shared.value, key_buckets, window, gram, zip_))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        ids, marks, keys = shared_keys(list(rows["packed"]))
        return pd.DataFrame({"doc_id": ids, "mark": marks, "key": keys.view(np.int64)})

    asked = texts.mapInArrow(ask, "bucket long, packed binary").groupBy("bucket") \
        .applyInPandas(answer, "doc_id long, mark long, key long")
    asked = write_table(asked.groupBy("doc_id", "mark").agg(F.collect_set("key").alias("keys")), "repeat-keys")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in _steps(batches):
            ids, marks, keys, col = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            wanted = (np.repeat(np.arange(len(ids)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy().view(np.uint64))
            yield from _packed(_super_kmers(Step(col), ids, marks, wanted, shared.value, buckets, window, gram, zip_))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(repeated_spans(list(rows["packed"]), window).T, columns=["doc_id", "mark", "from_word", "to_word"])

    sent = texts.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "keys", "text").mapInArrow(send, "bucket long, packed binary")
    return sent.groupBy("bucket").applyInPandas(decide, "doc_id long, mark long, from_word long, to_word long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_share: float = HOT_SHARE) -> DataFrame:
    """Every document (columns ``doc_id``, ``text``) without the words of windows that also start earlier:
    doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Earlier: in a document of smaller doc_id (null first; equal ids by the hash of the text), or at an
    earlier word of the same document.  Rows of equal id and text are one document and get the same
    result.  Null and empty texts have no words.  ``gram`` must not exceed ``window``.
    """
    texts = _texts(docs)
    spans = write_table(removed_spans(texts, window, gram, hot_share), "repeat-spans")
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    joined = texts.join(spans, ["doc_id", "mark"], "left") \
        .select("doc_id", "text", F.col("spans.from_word").alias("from_word"), F.col("spans.to_word").alias("to_word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column(1)):
                part = batch.slice(a, b - a)
                n_words, n_removed, kept = [], [], []
                for text, starts, ends in zip(*(c.to_pylist() for c in part.columns[1:])):
                    words = text.encode().split()
                    n = len(words)
                    if starts:
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, ends, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:n] == 0).tolist()]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(b" ".join(words))
                ids = pa.array([None if x == NULL_ID else x for x in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
