"""Chat formatting with DataFrame expressions only.

Template: every run of adjacent turns of one role is a block

    [TURN]role
    [TEXT]first text
    [NEXT]second text
    [/TURN]

Control strings inside roles and texts, with any backslashes before them, get one more backslash;
a line feed always stands between a text and a control string of the template, so reading back
is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own control strings and those of common chat templates.
CONTROL = ("[TURN]", "[/TURN]", "[TEXT]", "[NEXT]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLE = "assistant"

_ANY = "(?:" + "|".join(r"\Q" + c + r"\E" for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    """One backslash more before every control string."""
    return F.regexp_replace(text, r"(?<!\\)(\\*" + _ANY + ")", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*" + _ANY + ")", "$1")


def _real(*controls: str) -> str:
    return r"(?<!\\)(?:" + "|".join(r"\Q" + c + r"\E" for c in controls) + ")"


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, n_turns, formatted, and loss_spans:
    start and end (exclusive, code points) of the texts that carry loss, escaped as they stand.

    Turns go by ``turn`` (null first); equal numbers by role, then text.  A null text or role is
    empty; a null conv_id is a conversation of its own.  The turn structs of a conversation are
    collected and sorted, adjacent turns of one role merged, and the blocks concatenated; a
    conversation is one row and has to fit in a task, as its formatted text must.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    role = lambda k: F.get(F.col("_turns"), k)["role"]
    n = F.size("_turns")
    # positions where a block starts, and one past the last turn
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (role(k) != role(k - 1)))
    rows = rows.withColumn("_starts", F.concat(starts, F.array(n)))
    block = lambda s, k: F.slice("_turns", s + 1, F.get(F.col("_starts"), k + 1) - s)
    merged = F.transform(F.slice("_starts", F.lit(1), F.size("_starts") - 1), lambda s, k: F.struct(
        F.get(F.col("_turns"), s)["role"].alias("role"), F.transform(block(s, k), lambda t: escape(t["text"])).alias("texts")))
    rows = rows.withColumn("_blocks", merged)
    # pieces of output in order: (string, whether it carries loss)
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    pieces = F.flatten(F.transform("_blocks", lambda b: F.flatten(F.concat(
        F.array(F.array(piece(F.concat(F.lit("[TURN]"), escape(b["role"]), F.lit("\n[TEXT]")), F.lit(False)))),
        F.transform(b["texts"], lambda t, k: F.array(
            piece(F.when(k > 0, F.lit("\n[NEXT]")).otherwise(F.lit("")), F.lit(False)), piece(t, b["role"] == loss_role))),
        F.array(F.array(piece(F.lit("\n[/TURN]\n"), F.lit(False))))))))
    rows = rows.withColumn("_pieces", pieces)
    spans = F.aggregate(
        "_pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct((acc["at"] + F.length(p["piece"])).alias("at"), F.when(p["loss"], F.array_append(
            acc["spans"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["piece"])).alias("end")))).otherwise(acc["spans"]).alias("spans")))
    return rows.select("conv_id", n.cast("long").alias("n_turns"),
                       F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("formatted"),
                       spans["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.slice(F.split(formatted, _real("[TURN]"), -1), 2, 1 << 30)
    body = F.transform(blocks, lambda b: F.split(F.get(F.split(b, r"\n" + _real("[/TURN]"), -1), F.lit(0)),
                                                 r"\n" + _real("[TEXT]", "[NEXT]"), -1))
    return F.flatten(F.transform(body, lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.struct(
        unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
