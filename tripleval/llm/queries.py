"""The registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, write_table
from ..sources.tables import table
from . import chat, collocations, fingerprints, hard_negatives, jaccard_join, line_dedup, mixing, near_dedup, oracle, packing, secrets, substring_dedup, top_k, toxicity

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _Q[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_Q)


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", spread=True).withColumn("text", F.coalesce("text", F.lit("")))
    marked = docs.withColumn("mark", fingerprints.fingerprint(F.col("text")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = fingerprints.with_next(marked, ["text", "mark"]).select("doc_id", n.cast("long").alias("n_chars"), "mark", "next_mark",
                                                                   edited.alias("edited"))
    out = out.select("doc_id", "n_chars", "mark", "next_mark", F.sha2("edited", 256).alias("edited_sha256"),
                     fingerprints.fingerprint(F.col("edited")).alias("edited_mark"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprints.fingerprint_text(F.col("mark")).alias("fingerprint"),
                      fingerprints.fingerprint_text(F.col("edited_mark")).alias("edited_fingerprint"),
                      fingerprints.likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
                      fingerprints.likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings alone, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    done = chat.format_conversations(turns).withColumn("_turns", chat.read_turns(F.col("formatted"))) \
        .withColumn("_loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    turn = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens for all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", spread=True)
    pieces = write_table(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces)


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every query vector."""
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    out = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text", spread=True))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.KINDS.index("random"))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents at a similarity of 0.85."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text", spread=True))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text", spread=True)
    return mixing.mix(docs).drop("source", "shard")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity score of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", spread=True)
    out = toxicity.score(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", F.col("tox_held_out").alias("held_out"), F.col("tox_score").alias("score"),
                      F.col("tox_predicted").alias("predicted"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of three-line windows that also occur earlier."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text", spread=True))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that also start earlier."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text", spread=True))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of documents whose three-word shingles are similar to 0.90."""
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text", spread=True))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text", spread=True))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of 80 % to all of the score of each anchor's five positives."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return hard_negatives.hard_negatives(hard_negatives.shifted_labels(vectors))


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
