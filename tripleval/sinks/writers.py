"""Sinks: JSON lines, CSV, nested JSON summaries, Markdown export.

All writers are distributed (one file per task) and idempotent (overwrite of
a per-run folder).  Nothing is gathered into one task: the batch summary is a
one-line header plus result lines, not one document holding every result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import rank_global

METRICS = ["rouge1", "rouge2", "rougeL", "rougeLsum", "bleu"]


def sink_predictions_jsonl(predictions: DataFrame, path: str) -> None:
    """One JSON object per line with the four record keys; a folder per (model, distribution, variant)."""
    (predictions.select("model_id", "distribution", "variant",
                        F.col("observations").alias("Training Observations"), F.col("question").alias("Question"),
                        F.col("reference").alias("Reference"), F.col("prediction").alias("Prediction"))
     .write.mode("overwrite").partitionBy("model_id", "distribution", "variant").json(path))


def _block(dist: str, field: str) -> F.Column:
    return F.struct(*[F.max(F.when((F.col("distribution") == dist) & (F.col("metric") == m), F.col(field)))
                      .alias(m) for m in METRICS])


def metrics_summary(comparison: DataFrame, spectra: DataFrame | None = None) -> DataFrame:
    """One nested record per model.  The OD block is present only when both OD variants exist;
    the spectral block only when spectral results are given."""
    g = comparison.groupBy("model_id").agg(
        F.struct(_block("id", "baseline").alias("baseline"),
                 _block("id", "finetuned").alias("finetuned"),
                 _block("id", "delta").alias("improvements")).alias("in_distribution"),
        F.struct(_block("od", "baseline").alias("baseline"),
                 _block("od", "finetuned").alias("finetuned"),
                 _block("od", "delta").alias("improvements")).alias("od"),
        F.max(F.when(F.col("distribution") == "od", F.col("baseline"))).alias("_odb"),
        F.max(F.when(F.col("distribution") == "od", F.col("finetuned"))).alias("_odf"))
    g = g.withColumn("out_of_distribution",
                     F.when(F.col("_odb").isNotNull() & F.col("_odf").isNotNull(), F.col("od"))).drop("od", "_odb",
                                                                                                   "_odf")
    if spectra is not None:
        ww = spectra.groupBy("model_id").agg(F.struct(
            F.map_from_entries(F.collect_list(F.struct("metric", "baseline"))).alias("baseline"),
            F.map_from_entries(F.collect_list(F.struct("metric", "finetuned"))).alias("finetuned"),
            F.map_from_entries(F.collect_list(F.struct("metric", "delta"))).alias("changes")).alias("weightwatcher"))
        g = g.join(ww, "model_id", "left")
    return g.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def folder_name(model_id: F.Column) -> F.Column:
    """A model's folder: its id, or where that has other characters, a plain form and eight digits of its hash."""
    plain = F.regexp_replace(model_id, "[^A-Za-z0-9._-]", "_")
    return F.when(plain == model_id, plain).otherwise(
        F.concat(plain, F.lit("-"), F.substring(F.md5(model_id.cast("binary")), 1, 8)))


def sink_metrics_summary(comparison: DataFrame, path: str, spectra: DataFrame | None = None,
                         dir_col: F.Column | None = None) -> None:
    """``path/model_dir=<dir>/part-*.json``: one file with the nested summary of each model, which names
    its ``model_id`` (null blocks are omitted by the JSON writer)."""
    s = metrics_summary(comparison, spectra)
    d = dir_col if dir_col is not None else folder_name(F.col("model_id"))
    s.withColumn("model_dir", d).repartition("model_dir").write.mode("overwrite").partitionBy("model_dir").json(path)


def sink_batch_summary(runs: DataFrame, path: str) -> None:
    """``header/`` = timestamp and status counts; ``results/`` = one JSON line per run."""
    header = runs.agg(F.count(F.lit(1)).alias("total_models"),
                      F.count_if(F.col("status") == "success").alias("successful"),
                      F.count_if(F.col("status") == "failed").alias("failed"))
    header = header.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    cols = [c for c in ["run_id", "model_id", "model_name", "status", "duration_seconds", "output_dir", "error",
                        "metrics"] if c in runs.columns]
    runs.select(*cols).write.mode("overwrite").json(f"{path}/results")


def sink_fleet_summary(runs: DataFrame, comparison: DataFrame, path: str, spectra: DataFrame | None = None) -> None:
    """One batch-summary document for a fleet: status counts and ``results[]``, each run with its nested
    ``metrics``; ``src_batch_summary_documents`` reads it back.

    The document is one JSON object by its format, as long as the fleet's list of
    models; a run log of any length goes to ``sink_batch_summary``.
    """
    blocks = [c for c in ("in_distribution", "out_of_distribution", "weightwatcher")]
    nested = metrics_summary(comparison, spectra)
    nested = nested.select("model_id", F.struct(*[c for c in blocks if c in nested.columns]).alias("metrics"))
    cols = [c for c in ["run_id", "model_id", "model_name", "status", "duration_seconds", "output_dir", "error"] if c in runs.columns]
    results = runs.join(nested, "model_id", "left").select(F.struct(*cols, "metrics").alias("r"), "status")
    doc = results.agg(F.count(F.lit(1)).alias("total_models"), F.count_if(F.col("status") == "success").alias("successful"),
                      F.count_if(F.col("status") == "failed").alias("failed"), F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["model_id"] < b["model_id"], -1)
                                   .when(a["model_id"] > b["model_id"], 1).otherwise(0)).alias("results")) \
        .withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    doc.write.mode("overwrite").json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """Header CSV, quotes doubled inside quoted fields (readable by pandas); white space is kept."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def export_records(triplets: DataFrame, form: str | None) -> DataFrame:
    sel = triplets if form in (None, "All") else triplets.where(F.col("form") == form)
    return sel.select(F.col("triplet_id").alias("id"), "form",
                      F.col("observations").alias("Training Observations"),
                      F.col("question").alias("Question"), F.col("answer").alias("Answer"))


def export_json(triplets: DataFrame, form: str | None, path: str) -> None:
    export_records(triplets, form).write.mode("overwrite").json(path)


def export_csv(triplets: DataFrame, form: str | None, path: str) -> None:
    sink_csv(export_records(triplets, form), path)


def markdown_blocks(triplets: DataFrame, form: str | None, order_col: str = "triplet_id") -> DataFrame:
    """(item, block): item 0 is the title, item i the i-th triplet rendered as Markdown.

    The headings are fixed values of the export format."""
    sel = triplets if form in (None, "All") else triplets.where(F.col("form") == form)
    numbered = rank_global(sel, [order_col], rank_col="item")
    nl = "\n"
    block = F.concat_ws(nl,
                        F.concat(F.lit(nl + "## Triplet "), F.col("item").cast("string"), F.lit(nl)),
                        F.concat(F.lit("**Form:** "), F.coalesce(F.col("form"), F.lit("None")), F.lit(nl)),
                        F.concat(F.lit(nl + "**Observations:**" + nl), F.col("observations"), F.lit(nl)),
                        F.concat(F.lit(nl + "**Question:**" + nl), F.col("question"), F.lit(nl)),
                        F.concat(F.lit(nl + "**Answer:**" + nl), F.col("answer"), F.lit(nl)),
                        F.lit(nl + "---" + nl))
    title = triplets.sparkSession.createDataFrame(
        [(0, f"# IR-Triplet Export: {form or 'All'}\n")], "item long, block string")
    return title.unionByName(numbered.select(F.col("item").cast("long"), block.alias("block")))


def export_markdown(triplets: DataFrame, form: str | None, path: str) -> None:
    """Write the blocks in item order (range-partitioned files)."""
    blocks = markdown_blocks(triplets, form)
    blocks.repartitionByRange("item").sortWithinPartitions("item").select("block").write.mode("overwrite").text(path)
