"""Secret scans with DataFrame functions only: base patterns and a battery of randomness tests.

Base kinds: ``assign`` (a password-like name and its value), ``access`` (access key ids) and ``hex``
(long hexadecimal runs).  ``random`` adds long tokens that look like draws from an encoding's
alphabet.  Per token the encoding is inferred (the smallest alphabet that holds all its symbols);
a run that no encoding holds (one of + and /, and one of - and _) is split at the symbols outside
each alphabet, and its long parts are tokens, or the whole run if none is long.  Three tests are made against uniform draws: chi-squared on the symbol counts, runs above and
below the middle of the alphabet, and serial correlation.  A token passes the battery when none of
them rejects.

A second p-value speaks against ordinary text: the number of equal symbol pairs, which in ordinary
text is that of the letter frequencies below, restricted to the alphabet.  Within each stratum of
encoding and length, over all documents, Benjamini-Hochberg on a histogram of these p-values
decides which tokens are no ordinary text.  Short tokens get no small p-value, and so the length
counts twice: in the test and in the stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

# The base patterns; group 2 of ``assign`` is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

LEAST_TOKEN = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# (name, pattern of a whole token, alphabet), the smallest first; all-digit tokens are numbers, not keys.
ENCODINGS = (
    ("hex", "^(?![0-9]+$)[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^(?![0-9]+$)[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base62", "^(?![0-9]+$)[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    # what no encoding holds, and has no long part that one holds
    ("mixed", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)
# Letter frequencies of English text in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98,
           2.4, 0.15, 2.0, 0.074)
LENGTH_EDGES = (24, 32, 48, 96)
FALSE_DISCOVERIES = 0.05
REJECT_Z = 3.29
MOST_BUCKET = 400

SPAN = "struct<kind:int,start:bigint,end:bigint>"
TOKEN = "struct<start:bigint,end:bigint,stratum:int,p:int,passes:boolean>"


def match_spans(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """(start, end, match) of the leftmost non-overlapping matches, in code points; ``keep`` is an
    array of flags, one per match.  The gaps between matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    flags = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), flags.alias("keep"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    out = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add)["spans"]
    return F.when(text.rlike(pattern), out).otherwise(empty)


def _as_spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"),
                                                   m["end"].alias("end"))).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) of the base patterns."""
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
    return F.concat(_as_spans(match_spans(text, ASSIGN, long_value), "assign"), _as_spans(match_spans(text, ACCESS), "access"),
                    _as_spans(match_spans(text, HEX), "hex"))


def _ordinary(alphabet: str) -> tuple[float, float]:
    """Second and third moment of the symbol frequencies of ordinary text restricted to ``alphabet``."""
    p = [f for ch, f in zip(LOWER, LETTERS) if ch in alphabet or ch.upper() in alphabet]
    return sum(x * x for x in p) / sum(p) ** 2, sum(x ** 3 for x in p) / sum(p) ** 3


def _battery(token: Column, encoding: int) -> Column:
    """(p, passes) of a token under one encoding; p is the bucket floor(-2 ln p)."""
    alphabet = ENCODINGS[encoding][2]
    a, middle = len(alphabet), (len(alphabet) + 1) / 2
    n = F.length(token).cast("double")
    counts = F.transform(F.array(*[F.lit(ch) for ch in alphabet]),
                         lambda ch: n - F.length(F.replace(token, ch, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c)
    # chi-squared, by the cube-root normal approximation
    k = a - 1
    chi = F.lit(float(a)) / n * squares - n
    z_chi = (F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    # values 1 .. a in order of the alphabet
    values = F.transform(F.split(token, ""), lambda ch: F.instr(F.lit(alphabet), ch).cast("double"))

    def later(acc: Column, v: Column) -> Column:
        d, before = v - middle, acc["last"]
        return F.struct(d.alias("last"), (acc["runs"] + F.when((d > 0) != (before > 0), 1.0).otherwise(0.0)).alias("runs"),
                        (acc["high"] + F.when(d > 0, 1.0).otherwise(0.0)).alias("high"), (acc["sum"] + d).alias("sum"),
                        (acc["square"] + d * d).alias("square"), (acc["lag"] + d * before).alias("lag"))

    first = F.get(values, F.lit(0)) - middle
    start = F.struct(first.alias("last"), F.lit(1.0).alias("runs"), F.when(first > 0, 1.0).otherwise(0.0).alias("high"),
                     first.alias("sum"), (first * first).alias("square"), F.lit(0.0).alias("lag"))
    walk = F.aggregate(F.slice(values, F.lit(2), F.size(values)), start, later)

    def judge(w: Column) -> Column:
        pairs = 2 * w["high"] * (n - w["high"])
        spread = pairs * (pairs - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (w["runs"] - 1 - pairs / n) / F.sqrt(spread)).otherwise(F.lit(99.0))
        mean = w["sum"] / n
        variance = w["square"] - n * mean * mean
        # lag products around the mean, ends counted as inner symbols
        serial = F.when(variance > 0, (w["lag"] - (n - 1) * mean * mean) / variance * F.sqrt(n)).otherwise(F.lit(99.0))
        k2, k3 = _ordinary(alphabet)
        equal = (squares - n) / 2
        expected = n * (n - 1) / 2 * k2
        deviation = F.sqrt(n * (n - 1) / 2 * (k2 - k2 * k2) + n * (n - 1) * (n - 2) * max(k3 - k2 * k2, 0.0))
        z = (equal - expected) / deviation
        # the normal tail is below exp(-z^2 / 2) / 2
        bucket = F.when(z < 0, F.least(F.floor(z * z + 2 * math.log(2)), F.lit(MOST_BUCKET))).otherwise(F.lit(0)).cast("int")
        passes = (z_chi < REJECT_Z) & (F.abs(z_runs) < REJECT_Z) & (F.abs(serial) < REJECT_Z)
        return F.struct(bucket.alias("p"), passes.alias("passes"))

    return F.get(F.transform(F.array(walk), judge), F.lit(0))


def _tokens(run: Column) -> Column:
    """Array of (start, end, match): the run itself if an encoding holds it; else its parts of one alphabet
    each, which may overlap, or the run if no part is long enough."""
    def of(alphabet: str) -> Column:
        parts = match_spans(run["match"], "[" + alphabet.replace("-", r"\-") + f"]{{{LEAST_TOKEN},}}+")
        return F.transform(parts, lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"),
                                                     x["match"].alias("match")))

    parts = F.array_distinct(F.concat(*[of(alphabet) for _, _, alphabet in ENCODINGS[:-1]]))
    held = ~(run["match"].rlike("[+/]") & run["match"].rlike("[_-]"))
    return F.when(held, F.array(run)).otherwise(
        F.get(F.transform(F.array(parts), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(run))), F.lit(0)))


def random_tokens(text: Column) -> Column:
    """Array of (start, end, stratum, p, passes) of the candidate tokens of a text."""
    def under(m: Column, k: int) -> Column:
        n = F.length(m["match"])
        length_class = sum(((n >= e).cast("int") for e in LENGTH_EDGES), F.lit(0))
        stratum = (F.lit(k * (len(LENGTH_EDGES) + 1)) + length_class).cast("int")
        return F.get(F.transform(F.array(_battery(m["match"], k)), lambda x: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), stratum.alias("stratum"), x["p"].alias("p"),
            x["passes"].alias("passes"))), F.lit(0))

    def test(m: Column) -> Column:
        first = F.when(m["match"].rlike(ENCODINGS[0][1]), under(m, 0))
        for k in range(1, len(ENCODINGS)):
            first = first.when(m["match"].rlike(ENCODINGS[k][1]), under(m, k))
        return first

    tokens = F.flatten(F.transform(match_spans(text, CANDIDATE), _tokens))
    return F.transform(tokens, test).cast(f"array<{TOKEN}>")


def thresholds(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the least bucket that Benjamini-Hochberg accepts at ``rate``; at most one entry per
    stratum (35) comes to the driver, from a histogram of at most 401 buckets each."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.p").agg(F.count(F.lit(1)).alias("n"))
    rows: dict[int, dict[int, int]] = {}
    for r in counts.collect():
        rows.setdefault(r["stratum"], {})[r["p"]] = r["n"]
    out = {}
    for stratum, histogram in rows.items():
        total, beyond = sum(histogram.values()), 0
        for p in sorted(histogram, reverse=True):
            beyond += histogram[p]
            if p and math.exp(-p / 2) * total <= rate * beyond:
                out[stratum] = p
    return out


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id and ``spans``, sorted array of (start, kind, end), of every document (doc_id, text); kind numbers
    ``KINDS``.  Positions are code points, end exclusive.  A null text is empty.  A random span
    within a base span is left out.  Texts are read once; spans and token figures are written
    and read back for the thresholds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = write_table(docs.select("doc_id", base_spans(text).alias("base"), random_tokens(text).alias("tokens")), "secret-spans")
    limit = thresholds(found, rate)

    def accepted(t: Column) -> Column:
        ok = F.lit(False)
        for stratum, p in limit.items():
            ok = ok | ((t["stratum"] == stratum) & (t["p"] >= p))
        inside = F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))
        return ok & t["passes"] & ~inside

    extra = _as_spans(F.filter("tokens", accepted), "random")
    spans = F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", F.sort_array(spans).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
