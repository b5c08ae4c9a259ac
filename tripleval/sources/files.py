"""File sources with explicit schemas (never inferred)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import rank_global
from ..session import write_table
from .fixtures import FACT_COLS

# Keys of a triplet record (fixed values of the file format).
TRIPLET_KEYS = ("form", "Training Observations", "Question", "Answer")

TRIPLET_JSON_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(k, T.StringType()) for k in TRIPLET_KEYS]
    + [T.StructField("_corrupt_record", T.StringType())])

FACT_SCHEMA = T.StructType(
    [T.StructField("fact_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in FACT_COLS]
    + [T.StructField("rule template", T.StringType()), T.StructField("rule type", T.StringType()),
       T.StructField("rule", T.StringType())])

RESULT_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("model_id", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()), T.StructField("output_dir", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])

SUMMARY_HEADER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("total_models", T.LongType()),
    T.StructField("successful", T.LongType()), T.StructField("failed", T.LongType())])

# The keys of the nested metrics-summary file format
# (timestamp, in_distribution / out_of_distribution with baseline / finetuned /
# improvements blocks of the five metrics, and the weightwatcher block of maps).
METRIC_BLOCK = T.StructType([T.StructField(m, T.DoubleType())
                             for m in ["rouge1", "rouge2", "rougeL", "rougeLsum", "bleu"]])
DIST_BLOCK = T.StructType([T.StructField("baseline", METRIC_BLOCK), T.StructField("finetuned", METRIC_BLOCK),
                           T.StructField("improvements", METRIC_BLOCK)])
MAP = T.MapType(T.StringType(), T.DoubleType())
SPECTRAL_BLOCK = T.StructType([T.StructField("baseline", MAP), T.StructField("finetuned", MAP), T.StructField("changes", MAP)])
METRICS_SUMMARY_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("in_distribution", DIST_BLOCK),
    T.StructField("out_of_distribution", DIST_BLOCK),
    T.StructField("weightwatcher", SPECTRAL_BLOCK)])


SUMMARY_RESULT = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("output_dir", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("metrics", T.StructType([T.StructField("in_distribution", DIST_BLOCK),
                                           T.StructField("out_of_distribution", DIST_BLOCK),
                                           T.StructField("weightwatcher", SPECTRAL_BLOCK)]))])
BATCH_SUMMARY_DOC_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("total_models", T.LongType()),
    T.StructField("successful", T.LongType()), T.StructField("failed", T.LongType()),
    T.StructField("results", T.ArrayType(SUMMARY_RESULT))])


def src_batch_summary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Batch summaries written as one (pretty-printed) JSON document per fleet run.

    One row per result: the document's timestamp and run fields, with the
    nested ``metrics`` struct kept for path access (for example
    ``metrics.in_distribution.improvements.bleu``).  A document is bounded by
    its fleet size; files are parsed in parallel, one task per file.
    """
    docs = spark.read.schema(BATCH_SUMMARY_DOC_SCHEMA).option("multiLine", True).json(path)
    return (docs.select(F.col("timestamp").alias("summary_timestamp"), F.explode("results").alias("r"))
            .select("summary_timestamp", "r.*"))


TRIPLET_RECORD = T.StructType([f for f in TRIPLET_JSON_SCHEMA.fields if f.name != "_corrupt_record"])


def src_triplets_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Triplet records; ``_corrupt_record`` keeps the text of a malformed line or file (null otherwise).

    JSON lines (default, splittable) or, with ``multi_line``, one JSON array per
    file, as existing datasets are stored (one task per file; the format is one
    document).  A record without ``id`` takes its position, numbered globally in
    (file, position) order, so that the dataset order is kept; the numbering is
    only planned when such records exist.  A malformed file is one row with
    nothing but ``_corrupt_record``: it is never dropped here.
    """
    if not multi_line:
        df = (spark.read.schema(TRIPLET_JSON_SCHEMA).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
              .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                      F.monotonically_increasing_id().alias("_line")))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
        parsed = raw.withColumn("_records", F.from_json("value", T.ArrayType(TRIPLET_RECORD)))
        good = parsed.where(F.col("_records").isNotNull()).select(
            "_file", F.lit(0).cast("bigint").alias("_start"), F.posexplode("_records").alias("_line", "r"))
        good = good.select("r.*", F.lit(None).cast("string").alias("_corrupt_record"), "_file", "_start",
                           F.col("_line").cast("bigint").alias("_line"))
        bad = parsed.where(F.col("_records").isNull()).select(
            F.col("value").alias("_corrupt_record"), "_file", F.lit(0).cast("bigint").alias("_start"),
            F.lit(0).cast("bigint").alias("_line"))
        df = good.unionByName(bad, allowMissingColumns=True)
    df = write_table(df, "triplet-records")
    unnumbered = F.col("id").isNull() & F.col("_corrupt_record").isNull()
    if not df.where(unnumbered).isEmpty():
        sound = df.where(F.col("_corrupt_record").isNull())
        numbered = rank_global(sound, ["_file", "_start", "_line"], rank_col="_item", start=0)
        df = numbered.withColumn("id", F.coalesce(F.col("id"), F.col("_item"))).drop("_item").unionByName(
            df.where(F.col("_corrupt_record").isNotNull()))
    return df.select(F.col("id").alias("triplet_id"), F.lit("id").alias("dataset"), "form",
                     F.col("`Training Observations`").alias("observations"),
                     F.col("Question").alias("question"), F.col("Answer").alias("answer"), "_corrupt_record")


def sound_records(records: DataFrame) -> tuple[DataFrame, int]:
    """The records that could be read, and how many lines or files could not."""
    bad = records.where(F.col("_corrupt_record").isNotNull()).count()
    return records.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), bad


def src_fact_files(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet", **options) -> DataFrame:
    """One logical fact table from several files, concatenated in the given order and
    aligned by column name (missing columns are null); ``file_split`` keeps provenance."""
    parts = [spark.read.format(fmt).options(**options).load(p).withColumn("file_split", F.lit(k))
             for k, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# The strings pandas.read_csv reads as missing by default.
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def src_csv(spark: SparkSession, path: str, schema: T.StructType, na_values=PANDAS_NA_VALUES) -> DataFrame:
    """Header CSV with an explicit schema; quoted multi-line fields allowed.

    String fields equal to one of ``na_values`` become null, as pandas reads them."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("nullValue", "\u0000")      # a field without quotes and text is null, "" an empty text
          .schema(schema).csv(path))
    if not na_values:
        return df
    na = F.array(*[F.lit(v) for v in na_values])
    return df.select(*[
        F.when(F.array_contains(na, F.col(f"`{f.name}`")), F.lit(None).cast("string"))
        .otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`") for f in schema.fields])


def src_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run results of a batch summary folder: the ``results/`` JSON lines, one row per run
    (nested ``metrics`` map kept; the header counts are read by ``src_summary_header``)."""
    results = spark.read.schema(RESULT_SCHEMA).json(f"{path}/results")
    return results


def src_summary_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_HEADER_SCHEMA).json(f"{path}/header")


def src_metric_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """Metrics summaries of many model folders -> long (model_dir, distribution, variant, metric, value).

    ``model_dir`` is the model's id where the summary names it, else its folder's name."""
    # one summary object per file, possibly pretty-printed over several lines
    df = spark.read.schema(METRICS_SUMMARY_SCHEMA).option("multiLine", True).json(path_glob).withColumn(
        "model_dir", F.coalesce("model_id", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?([^/=]+)/[^/]+$", 1)))
    rows = []
    for dist, block in (("id", "in_distribution"), ("od", "out_of_distribution")):
        for variant in ("baseline", "finetuned"):
            for m in ["rouge1", "rouge2", "rougeL", "rougeLsum", "bleu"]:
                rows.append(F.struct(F.lit(dist).alias("distribution"), F.lit(variant).alias("variant"),
                                     F.lit(m).alias("metric"), F.col(f"{block}.{variant}.{m}").alias("value")))
    return (df.select("model_dir", F.explode(F.array(*rows)).alias("r"))
            .select("model_dir", "r.*").where(F.col("value").isNotNull()))


def src_model_registry(spark: SparkSession, models: Sequence[str], dirs: Mapping[str, str] | None = None) -> DataFrame:
    """(idx, model_id, output_dir): an ordered list of models (0-based) with their output folders, null where the map has
    none.  A model listed twice keeps its first place; folders of models that are not listed are an error."""
    listed = list(dict.fromkeys(models))
    unknown = sorted(set(dirs or {}) - set(listed))
    if unknown:
        raise ValueError(f"output folders of models that are not listed: {', '.join(unknown)}")
    return spark.createDataFrame([(i, m, (dirs or {}).get(m)) for i, m in enumerate(listed)],
                                 "idx int, model_id string, output_dir string")
