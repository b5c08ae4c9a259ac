"""Registered queries: file sources and sinks, exports, the streaming summary, the fleet.

Each sink query writes the derived table to a fresh folder under the shared
checkpoint folder and reads it back through the matching source, so both
directions of the format run over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.models import export_file_name, sql_export_file_name
from ..operators.explore import sorted_forms
from ..operators.generate import NATIVE_GENERATORS
from ..session import scratch_path, write_table
from ..sinks import writers
from ..sources import files, fixtures
from ..streaming.run_summary import improvement_rows, metrics_map, stream_improvement_table, stream_run_summary
from . import evaluate as ev
from .fleet import run_fleet
from .oracle import sql
from .registry import evaluation, examples, register

TRIP = ["triplet_id", "dataset", "form", "observations", "question", "answer"]
FACT_COLS = fixtures.FACT_COLS
MD_FORM = "en"


@register("src_triplets_json", sql(f"SELECT {', '.join(TRIP)} FROM id_trip", "id_trip"))
def q_src_triplets_json(spark, d):
    path = scratch_path(spark, "triplets-json")
    writers.export_json(fixtures.id_triplets(spark, d), None, path)
    return files.src_triplets_json(spark, path).select(*TRIP)


@register("src_triplets_json_array", sql(f"""SELECT row_number() OVER (ORDER BY triplet_id) - 1 AS triplet_id,
    {', '.join(TRIP[1:])} FROM id_trip""", "id_trip"))
def q_src_triplets_json_array(spark, d):
    """Files of one JSON array each, whose records have no id: positions in (file, position) order."""
    path = scratch_path(spark, "triplets-json-array")
    records = writers.export_records(fixtures.id_triplets(spark, d), None)
    part = F.format_string("%012d", F.floor(F.col("id") / 500))
    keys = [F.col(f"`{k}`") for k in files.TRIPLET_KEYS]
    arrays = (records.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", *keys))).alias("r"))
              .select("part", F.to_json(F.transform("r", lambda r: r.dropFields("id"))).alias("value")))
    arrays.repartition("part").write.mode("overwrite").partitionBy("part").text(path)
    return files.src_triplets_json(spark, f"{path}/*/*.txt", multi_line=True).select(*TRIP)


@register("export_json", sql(f"SELECT {', '.join(TRIP)} FROM id_trip WHERE form = 'fr'", "id_trip"))
def q_export_json(spark, d):
    path = scratch_path(spark, "export-json")
    writers.export_json(fixtures.id_triplets(spark, d), "fr", path)
    return files.src_triplets_json(spark, path).select(*TRIP)


_TRIPLET_CSV = T.StructType([T.StructField("id", T.LongType()), T.StructField("form", T.StringType()),
                             T.StructField("Training Observations", T.StringType()),
                             T.StructField("Question", T.StringType()), T.StructField("Answer", T.StringType())])


def _read_triplet_csv(spark, path):
    return files.src_csv(spark, path, _TRIPLET_CSV, na_values=()).select(
        F.col("id").alias("triplet_id"), "form", F.col("`Training Observations`").alias("observations"),
        F.col("Question").alias("question"), F.col("Answer").alias("answer"))


@register("export_csv", sql("SELECT triplet_id, form, observations, question, answer FROM id_trip WHERE form = 'de'",
                            "id_trip"))
def q_export_csv(spark, d):
    path = scratch_path(spark, "export-csv")
    writers.export_csv(fixtures.id_triplets(spark, d), "de", path)
    return _read_triplet_csv(spark, path)


@register("sink_csv", sql("SELECT triplet_id, form, observations, question, answer FROM id_trip", "id_trip"))
def q_sink_csv(spark, d):
    path = scratch_path(spark, "sink-csv")
    writers.sink_csv(writers.export_records(fixtures.id_triplets(spark, d), None), path)
    return _read_triplet_csv(spark, path)


_FACT_OUT = ["fact_id", *FACT_COLS, "rule template", "rule type", "rule"]


@register("src_csv", sql("SELECT " + ", ".join(f'"{c}"' for c in _FACT_OUT) + " FROM facts", "facts"))
def q_src_csv(spark, d):
    path = scratch_path(spark, "facts-csv")
    writers.sink_csv(fixtures.facts(spark, d).select(*[F.col(f"`{c}`") for c in _FACT_OUT]), path)
    return files.src_csv(spark, path, files.FACT_SCHEMA)


@register("src_fact_files", sql(
    "SELECT fact_id, file_split, " + ", ".join(f'"{c}"' for c in _FACT_OUT[1:]) + " FROM facts", "facts"))
def q_src_fact_files(spark, d):
    """Three files (test, train, val): train has its columns in another order, val lacks ``fact 3.2``."""
    f = fixtures.facts(spark, d)
    base = scratch_path(spark, "fact-files")
    layouts = {"test": _FACT_OUT, "train": list(reversed(_FACT_OUT)),
               "val": [c for c in _FACT_OUT if c != "fact 3.2"]}
    paths = {}
    for split, cols in layouts.items():
        paths[split] = f"{base}/{split}"
        writers.sink_csv(f.where(F.col("file_split") == split).select(*[F.col(f"`{c}`") for c in cols]),
                         paths[split])
    out = files.src_fact_files(spark, paths, "csv", header=True, multiLine=True, escape='"',
                               ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return out.select(F.col("fact_id").cast("bigint").alias("fact_id"), "file_split",
                      *[F.col(f"`{c}`") for c in _FACT_OUT[1:]])


def _batch_summary(spark, d):
    path = scratch_path(spark, "batch-summary")
    writers.sink_batch_summary(fixtures.runs(spark, d), path)
    return path


@register("sink_batch_summary", sql("""SELECT count(*) AS total_models,
    count(*) FILTER (WHERE status = 'success') AS successful,
    count(*) FILTER (WHERE status = 'failed') AS failed FROM runs""", "runs"))
def q_sink_batch_summary(spark, d):
    return files.src_summary_header(spark, _batch_summary(spark, d)).select("total_models", "successful", "failed")


@register("src_run_summaries", sql("""SELECT run_id, model_id, model_name, status, duration_seconds, output_dir, error
    FROM runs""", "runs"))
def q_src_run_summaries(spark, d):
    return files.src_run_summaries(spark, _batch_summary(spark, d)).select(
        "run_id", "model_id", "model_name", "status", "duration_seconds", "output_dir", "error")


def _with_spectra(spark, d):
    """Comparison and spectral changes of the generators, which have weights here."""
    e = ev.evaluate_models(examples(spark, d), weights=fixtures.generator_weights(spark, d, NATIVE_GENERATORS))
    return write_table(e.comparison, "comparison"), write_table(e.spectra, "spectra")


def _spectral_rows(*parts):
    """The spectral block's maps as rows: metric and a column for each part (block, name)."""
    first = F.col(f"{parts[0][0]}")
    return F.transform(F.map_keys(first), lambda m: F.struct(
        F.lit("spectral").alias("distribution"), m.alias("metric"), *[F.col(block)[m].alias(name) for block, name in parts]))


SPECTRAL_SQL = f"""UNION ALL SELECT model_id, {{status}} 'spectral' AS distribution, metric, {{cols}} FROM
    {fixtures.generator_spectra_sql(NATIVE_GENERATORS)} WHERE model_id IS NOT NULL"""


@register("stream_improvement_table", sql("""SELECT model_id, printf('%+.4f', max(CASE WHEN metric = 'rouge1' THEN delta END)) AS delta_rouge1,
    printf('%+.4f', max(CASE WHEN metric = 'rougeL' THEN delta END)) AS delta_rougeL,
    printf('%+.4f', max(CASE WHEN metric = 'bleu' THEN delta END)) AS delta_bleu
    FROM comparison WHERE distribution = 'id' GROUP BY model_id""", "comparison"))
def q_stream_improvement_table(spark, d):
    """The improvement table from a stream over landings of run results: a stale run, the run, a repeat and a failed run."""
    base = scratch_path(spark, "improvement-stream")
    results = metrics_map(write_table(evaluation(spark, d).comparison, "comparison"))
    none = F.lit(None).cast("map<string,double>")
    for run_id, status, metrics in ((2, "success", F.col("metrics")), (1, "success", F.transform_values("metrics", lambda k, v: v - 1)),
                                    (2, "success", F.col("metrics")), (3, "failed", none)):
        results.select(F.lit(run_id).cast("long").alias("run_id"), "model_id", F.lit(status).alias("status"), metrics.alias("metrics")) \
            .write.mode("append").json(f"{base}/results")
    stream_improvement_table(spark, f"{base}/results", f"{base}/checkpoint", f"{base}/out", max_files_per_trigger=1).awaitTermination()
    return improvement_rows(spark, f"{base}/out")


@register("src_batch_summary_documents", sql(f"""SELECT model_id, 'success' AS status, distribution, metric, baseline, finetuned,
    delta AS improvement FROM comparison {SPECTRAL_SQL.format(status="'success',", cols="baseline, finetuned, delta")}""",
                                             "comparison", "spectra_cmp"))
def q_src_batch_summary_documents(spark, d):
    """A fleet's summary document with nested metrics and spectral changes, written and read back."""
    path = scratch_path(spark, "fleet-summary")
    comparison, spectra = _with_spectra(spark, d)
    runs = comparison.select("model_id").distinct().withColumn("status", F.lit("success"))
    writers.sink_fleet_summary(runs, comparison, path, spectra)
    doc = files.src_batch_summary_documents(spark, path)
    rows = [F.struct(F.lit(dist).alias("distribution"), F.lit(m).alias("metric"),
                     *[F.col(f"metrics.{block}.{part}.{m}").alias(name) for part, name in (
                         ("baseline", "baseline"), ("finetuned", "finetuned"), ("improvements", "improvement"))])
            for dist, block in (("id", "in_distribution"), ("od", "out_of_distribution")) for m in writers.METRICS]
    spectral = _spectral_rows(("metrics.weightwatcher.baseline", "baseline"), ("metrics.weightwatcher.finetuned", "finetuned"),
                              ("metrics.weightwatcher.changes", "improvement"))
    return doc.select("model_id", "status", F.explode(F.concat(F.array(*rows), spectral)).alias("r")).select("model_id", "status", "r.*")


@register("sink_predictions_jsonl", sql("""SELECT model_id, distribution, variant,
    observations AS "Training Observations", question AS "Question", reference AS "Reference",
    prediction AS "Prediction" FROM preds""", "preds"))
def q_sink_predictions_jsonl(spark, d):
    path = scratch_path(spark, "predictions")
    writers.sink_predictions_jsonl(ev.predictions(examples(spark, d)), path)
    schema = T.StructType([T.StructField(k, T.StringType())
                           for k in ["Training Observations", "Question", "Reference", "Prediction",
                                     "model_id", "distribution", "variant"]])
    return spark.read.schema(schema).json(path)


def _metric_files(spark, d):
    path = scratch_path(spark, "metric-files")
    writers.sink_metrics_summary(evaluation(spark, d).comparison, path)
    return path


@register("src_metric_files", sql("""SELECT model_id AS model_dir, distribution, variant, metric, value FROM metrics""",
                                  "metrics"))
def q_src_metric_files(spark, d):
    return files.src_metric_files(spark, f"{_metric_files(spark, d)}/*/*.json")


@register("sink_metrics_summary", sql(f"""SELECT model_id AS model_dir, distribution, metric, delta AS improvement
    FROM comparison {SPECTRAL_SQL.format(status="", cols="delta")}""", "comparison", "spectra_cmp"))
def q_sink_metrics_summary(spark, d):
    path = scratch_path(spark, "metric-files")
    comparison, spectra = _with_spectra(spark, d)
    writers.sink_metrics_summary(comparison, path, spectra)
    df = spark.read.schema(files.METRICS_SUMMARY_SCHEMA).json(f"{path}/*/*.json").withColumnRenamed("model_id", "model_dir")
    rows = [F.struct(F.lit(dist).alias("distribution"), F.lit(m).alias("metric"),
                     F.col(f"{block}.improvements.{m}").alias("improvement"))
            for dist, block in (("id", "in_distribution"), ("od", "out_of_distribution")) for m in writers.METRICS]
    spectral = _spectral_rows(("weightwatcher.changes", "improvement"))
    return df.select("model_dir", F.explode(F.concat(F.array(*rows), spectral)).alias("r")).select("model_dir", "r.*")


@register("export_markdown", sql(f"""SELECT unnest(string_split(block, chr(10))) AS line FROM (
    SELECT '# IR-Triplet Export: {MD_FORM}' || chr(10) AS block
    UNION ALL
    SELECT concat_ws(chr(10),
        chr(10) || '## Triplet ' || CAST(item AS VARCHAR) || chr(10),
        '**Form:** ' || coalesce(form, 'None') || chr(10),
        chr(10) || '**Observations:**' || chr(10) || observations || chr(10),
        chr(10) || '**Question:**' || chr(10) || question || chr(10),
        chr(10) || '**Answer:**' || chr(10) || answer || chr(10),
        chr(10) || '---' || chr(10)) AS block
    FROM (SELECT *, row_number() OVER (ORDER BY triplet_id) AS item FROM id_trip WHERE form = '{MD_FORM}'))""",
                                 "id_trip"))
def q_export_markdown(spark, d):
    """The lines of the written files."""
    path = scratch_path(spark, "export-md")
    writers.export_markdown(fixtures.id_triplets(spark, d), MD_FORM, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("export_file_name", sql(f"""SELECT form, ext, {sql_export_file_name('form', 'ext')} AS file_name FROM
    (SELECT 'All' AS form UNION ALL SELECT DISTINCT form FROM id_trip WHERE form IS NOT NULL),
    (VALUES ('json'), ('csv'), ('md')) e(ext)""", "id_trip"))
def q_export_file_name(spark, d):
    forms = sorted_forms(fixtures.id_triplets(spark, d)).select("form")
    exts = F.explode(F.array(F.lit("json"), F.lit("csv"), F.lit("md")))
    return (forms.select("form", exts.alias("ext"))
            .select("form", "ext", export_file_name(F.col("form"), F.col("ext")).alias("file_name")))


@register("stream_run_summary", sql("SELECT status, count(*) AS n FROM runs GROUP BY status", "runs"))
def q_stream_run_summary(spark, d):
    """Run records land as several files; the stream's final state equals the batch counts."""
    base = scratch_path(spark, "stream")
    runs_dir, out_dir = f"{base}/runs", f"{base}/summary"
    fixtures.runs(spark, d).repartitionByRange("run_id").write.mode("overwrite").parquet(runs_dir)
    q = stream_run_summary(spark, runs_dir, f"{base}/checkpoint", out_dir)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out_dir)


@register("run_fleet", sql("""SELECT model_id, model_id AS model_name, 'success' AS status,
    CAST(NULL AS VARCHAR) AS error, variant, distribution, metric, value, n_examples FROM metrics""", "metrics"))
def q_run_fleet(spark, d):
    """One generation job per model with failure isolation, then one scoring job over all
    successful models; rows = each run record with its model's metrics (timings left out)."""
    runs, m = run_fleet(spark, examples(spark, d), ev.NATIVE_GENERATORS)
    return (runs.join(m, "model_id", "left")
            .select("model_id", "model_name", "status", "error", "variant", "distribution", "metric", "value",
                    "n_examples"))
