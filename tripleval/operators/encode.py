"""Training-example encoding: vocabulary, token ids, truncation, label masks, padded batches.

Re-aims a pretrained sub-word tokenizer as a word vocabulary learned from the
training split; the array operations (truncate, mask, pad) are native
higher-order functions on ``array<int>`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rouge_tokens
from ..session import write_table
from . import joins
from .joins import checked_join, measured, parted_by_count, runs_of, skew_split_join
from .numbering import rank_global

# Reserved ids and the label sentinel.
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
IGNORE = -100
MAX_LEN = 512
# Place of the first token of a response; the prompt's is 0.
RESPONSE = 1 << 31
# Bits of an id below its place.
ID_BITS = 31


def build_vocab(train_examples: DataFrame, max_size: int | None = None) -> DataFrame:
    """(token, token_id, count): ids by (count desc, token asc) after the reserved ids.

    Counting is a grouped aggregation with map-side combine; numbering is the
    range-partitioned ``rank_global`` (no single-partition window).
    """
    toks = train_examples.select(F.explode(F.concat(rouge_tokens(F.col("prompt")),
                                                    rouge_tokens(F.col("response")))).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    ranked = rank_global(counts, [F.desc("count"), F.asc("token")], rank_col="rank")
    if max_size is not None:
        ranked = ranked.where(F.col("rank") <= max_size)
    return ranked.select("token", (F.col("rank") + UNK_ID).cast("int").alias("token_id"), "count")


def encode_examples(examples: DataFrame, vocab: DataFrame, keys=("example_id",)) -> DataFrame:
    """Tokenise prompt and response separately (no special tokens): (keys, prompt_ids, answer_ids).

    ``keys`` must identify an example (``(dataset, example_id)`` when datasets
    are mixed).  Plan: prompt and response tokens are exploded where they are,
    with their place, and meet the vocabulary by broadcast, whole when its
    measured size allows, else its most frequent words.  Ids of consecutive
    places are put into arrays before the one shuffle by example key; a rarer
    word leaves a gap there, is shuffled to meet its id, and comes back as one
    long, its place above its id.  An example without tokens keeps its row, one
    without a prompt or response has none.  One example's tokens form one group by definition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def tagged(col: str, side: int) -> Column:
        return F.transform(rouge_tokens(F.col(col)), lambda t, i: F.struct(
            (i.cast("long") + F.lit(side * RESPONSE)).alias("place"), t.alias("token")))

    # numbered before the explode, so that the tokens of one example share their number
    toks = examples.where("prompt IS NOT NULL AND response IS NOT NULL") \
        .select(*keys, F.monotonically_increasing_id().alias("_row"), F.concat(tagged("prompt", 0), tagged("response", 1)).alias("_t")) \
        .select(*keys, "_row", F.explode_outer("_t").alias("t")).select(*keys, "_row", "t.place", "t.token")
    words = vocab.select("token", F.col("token_id").alias("id"), *(["count"] if "count" in vocab.columns else []))
    _, size, largest = measured(words)
    gaps = size > joins.BROADCAST_BYTES
    if gaps and "count" in words.columns:
        often, seldom = parted_by_count(words, "count", joins.BROADCAST_BYTES, largest)
    else:
        often, seldom = (words.limit(0), words) if gaps else (words, None)
    near = toks.join(F.broadcast(often.select("token", "id")), "token", "left")
    unknown = F.col("token").isNull() if gaps else F.lit(True)
    coded = near.withColumns({"id": F.when(F.col("id").isNull() & unknown, UNK_ID).otherwise(F.col("id")),
                              "place": F.coalesce("place", F.lit(-1).cast("long"))})
    runs = runs_of(coded, keys, "id", "_row", "place").select(*keys, F.struct("place", "id").alias("run"))
    if gaps:
        rest = toks.join(F.broadcast(often.select("token")), "token", "left_anti").select(*keys, "place", "token")
        far = skew_split_join(rest, seldom.select("token", "id"), ["token"], 1, "left", joins.BROADCAST_BYTES // largest)
        fill = F.shiftleft(F.col("place"), ID_BITS) + F.coalesce("id", F.lit(UNK_ID))
        runs = runs.withColumn("fill", F.lit(None).cast("long")) \
            .unionByName(far.select(*keys, F.lit(None).cast(runs.schema["run"].dataType).alias("run"), fill.alias("fill")))
        runs = runs.groupBy(*keys).agg(F.sort_array(F.collect_list("run")).alias("run"), F.sort_array(F.collect_list("fill")).alias("fill"))
    else:
        runs = runs.groupBy(*keys).agg(F.sort_array(F.collect_list("run")).alias("run"))

    for side, first in (("prompt", 0), ("response", RESPONSE)):
        last = first + RESPONSE - 1
        runs = runs.withColumn(f"_{side}", F.filter("run", lambda r: r["place"].between(first, last)))
        if gaps:
            runs = runs.withColumn(f"_{side}_fill", F.transform(
                F.filter("fill", lambda f: F.shiftright(f, ID_BITS).between(first, last)),
                lambda f: F.struct(F.shiftright(f, ID_BITS).alias("p"), f.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("x"))))
    # the row of a side as a column of its own, for the gaps are filled from slices of it
    rows = runs.withColumns({f"_{side}_row": F.flatten(F.transform(f"_{side}", lambda r: r["id"])) for side in ("prompt", "response")})

    def ids(side: str, first: int) -> Column:
        here, row = F.col(f"_{side}"), F.col(f"_{side}_row")
        places = F.array_max(F.transform(here, lambda r: r["place"] + F.size(r["id"]))) - first
        each = F.flatten(F.transform(here, lambda r: F.transform(r["id"], lambda x, i: F.struct((r["place"] + i).alias("p"), x.alias("x")))))
        held = F.size(row)
        if gaps:
            fills = F.col(f"_{side}_fill")
            each = F.concat(F.filter(each, lambda t: t["x"].isNotNull()), fills)
            row = _filled(row, fills, first)
        # examples of one key share their places, and lie in each other
        return F.when(held > places, F.transform(F.sort_array(each), lambda t: t["x"])).otherwise(row)

    return rows.select(*keys, ids("prompt", 0).alias("prompt_ids"), ids("response", RESPONSE).alias("answer_ids"))


def _filled(row: Column, fills: Column, first: int) -> Column:
    """``row`` with the (place, id) of ``fills``, in the order of places, in its gaps."""
    at = F.transform(fills, lambda f: (f["p"] - first).cast("int"))
    before = F.concat(F.array(F.lit(-1)), at)
    parts = F.zip_with(fills, F.slice(before, 1, F.greatest(F.size(fills), F.lit(0))), lambda f, b: F.concat(
        F.slice(row, b + 2, (f["p"] - first).cast("int") - b - 1), F.array(f["x"])))
    done = F.element_at(before, -1)
    tail = F.slice(row, done + 2, F.greatest(F.size(row) - done - 1, F.lit(0)))
    return F.when(F.size(fills) == 0, row).otherwise(F.concat(F.flatten(parts), tail))


def truncate_left(ids: Column, max_len: int = MAX_LEN) -> Column:
    """Keep the last ``max_len`` ids when longer."""
    return F.when(F.size(ids) > max_len, F.slice(ids, -max_len, max_len)).otherwise(ids)


def truncate_head(ids: Column, max_len: int = MAX_LEN) -> Column:
    return F.when(F.size(ids) > max_len, F.slice(ids, 1, max_len)).otherwise(ids)


def truncate_inference_prompt(ids: Column, max_len: int = MAX_LEN, keep: str = "tail") -> Column:
    """Generation input limit: ``tail`` keeps the question and answer marker, ``head`` the start."""
    if keep == "tail":
        return truncate_left(ids, max_len)
    if keep == "head":
        return truncate_head(ids, max_len)
    raise ValueError("keep must be 'tail' or 'head'")


def mask_labels(encoded: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """input_ids = last ``max_len`` of prompt + answer; labels mask every kept prompt position."""
    ids = truncate_left(F.concat("prompt_ids", "answer_ids"), max_len)
    kept_prompt = F.least(F.size("prompt_ids"), F.greatest(F.lit(0), F.lit(max_len) - F.size("answer_ids")))
    return (encoded.withColumn("input_ids", ids).withColumn("kept_prompt", kept_prompt)
            .withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE), F.col("kept_prompt")),
                                           F.slice("input_ids", F.col("kept_prompt") + 1,
                                                   F.greatest(F.size("input_ids") - F.col("kept_prompt"), F.lit(0)))))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))


def pad_batches(masked: DataFrame, batch_size: int = 8, key: str = "example_id", pad_id: int = PAD_ID) -> DataFrame:
    """Consecutive batches in key order, right-padded to the batch maximum length.

    ``batch_id`` comes from the global numbering.  The rows stay where it put
    them: the maximum of a batch, from the lengths alone, goes to them by
    broadcast while its measured size allows.
    """
    ranked = rank_global(masked.select(key, "input_ids", "attention_mask", "labels"), [key], rank_col="_rank", stored=True)
    with_batch = ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch_size).cast("bigint")) \
        .withColumn("pos_in_batch", ((F.col("_rank") - 1) % batch_size).cast("int"))
    longest = with_batch.groupBy("batch_id").agg(F.max(F.size("input_ids")).alias("_max"))
    padded = checked_join(with_batch, write_table(longest, "batch-lengths"), ["batch_id"], small_rows_per_key=1)
    fill = F.col("_max") - F.size("input_ids")
    return padded.select(
        key, "batch_id", "pos_in_batch",
        F.concat("input_ids", F.array_repeat(F.lit(pad_id), fill)).alias("input_ids"),
        F.concat("attention_mask", F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
        F.concat("labels", F.array_repeat(F.lit(IGNORE), fill)).alias("labels"))


def batch_prompts(df: DataFrame, order_cols, size: int = 4) -> DataFrame:
    """Fixed groups of ``size`` consecutive prompts for generation."""
    ranked = rank_global(df, order_cols, rank_col="_rank")
    return ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / size).cast("bigint")).drop("_rank")
