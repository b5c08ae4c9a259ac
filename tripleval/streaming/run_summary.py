"""Keep the run-status summary and the improvement table current while run records land.

Structured Streaming file source over ``runs/`` (explicit schema), duplicates
of a run dropped, status counts in complete mode written by ``foreachBatch`` to
an overwrite-idempotent folder.  The checkpoint makes the query restartable; the
``availableNow`` trigger processes what has landed and stops.  By default every
record counts, whenever it lands: the de-duplication keeps one small row per run
in the state store (RocksDB, on disk).  With a ``watermark`` the state is bounded
instead, records later than it are dropped, and ``late_rows`` tells how many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.compare import signed
from ..session import cpu_partitions

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("model_id", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("ended_at", T.TimestampNTZType()),
    T.StructField("duration_seconds", T.DoubleType()), T.StructField("error", T.StringType()),
    T.StructField("output_dir", T.StringType())])


def _stream_session(spark: SparkSession, state_partitions: int | None) -> SparkSession:
    """A session of its own for a stream: the number of state partitions is fixed from
    ``spark.sql.shuffle.partitions`` when a query first starts, and the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or cpu_partitions(spark)))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def late_rows(query: StreamingQuery) -> int:
    """Records that the query's watermark has dropped so far (over the progress reports it keeps)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def status_counts_stream(spark: SparkSession, runs_dir: str, watermark: str | None = None,
                         max_files_per_trigger: int = 64) -> DataFrame:
    runs = spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(runs_dir)
    if watermark is None:
        dedup = runs.dropDuplicates(["run_id"])
    else:
        dedup = (runs.withColumn("event_time", F.col("started_at").cast("timestamp"))
                 .withWatermark("event_time", watermark)
                 .dropDuplicatesWithinWatermark(["run_id"]))
    return dedup.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_run_summary(spark: SparkSession, runs_dir: str, checkpoint: str, out_dir: str,
                       available_now: bool = True, state_partitions: int | None = None,
                       max_files_per_trigger: int = 64, watermark: str | None = None) -> StreamingQuery:
    """Start the summary stream; each micro-batch overwrites ``out_dir`` with the full counts."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out_dir)

    own = _stream_session(spark, state_partitions)
    writer = (status_counts_stream(own, runs_dir, watermark, max_files_per_trigger)
              .writeStream.outputMode("complete")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


RESULT_STREAM_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("model_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])

IMPROVEMENT_METRICS = ("rouge1", "rougeL", "bleu")


def metrics_map(comparison: DataFrame) -> DataFrame:
    """(model_id, metrics): the comparison table as one map per model with keys
    ``{distribution}.{baseline|finetuned|delta}.{metric}`` (bounded by the metric list)."""
    entries = comparison.select("model_id", F.explode(F.array(*[
        F.struct(F.concat_ws(".", "distribution", F.lit(part), "metric").alias("k"), F.col(part).alias("v"))
        for part in ("baseline", "finetuned", "delta")])).alias("e")).where(F.col("e.v").isNotNull())
    return entries.groupBy("model_id").agg(F.map_from_entries(F.collect_list("e")).alias("metrics"))


IMPROVEMENT_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("run_id", T.LongType()),
    *[T.StructField(f"delta_{m}", T.DoubleType()) for m in IMPROVEMENT_METRICS], T.StructField("expired", T.BooleanType())])


class LatestRun(StatefulProcessor):
    """Keeps each model's latest successful run (highest ``run_id``) and emits a row when it changes.

    Late runs and repeated landings change nothing.  A run that lands again with other metrics is a correction:
    of equal run ids the larger metrics tuple wins (nulls first), so that the order of landings does not matter.
    With ``keep_ms``, a model without a new result for that long leaves the table, and its state goes."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType(IMPROVEMENT_SCHEMA.fields[1:-1]))

    @staticmethod
    def _order(run: tuple) -> tuple:
        return (run[0], *[(v is not None, v or 0.0) for v in run[1:]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        best = before
        for frame in rows:
            for run in frame[[f.name for f in IMPROVEMENT_SCHEMA.fields[1:-1]]].itertuples(index=False, name=None):
                run = (int(run[0]), *[None if pd.isna(v) else float(v) for v in run[1:]])
                if best is None or self._order(run) > self._order(best):
                    best = run
        if self.keep_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if best is not None and best != before:
            self.latest.update(best)
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = tuple(self.latest.get())
        self.latest.clear()
        yield self._row(key, run, True)

    @staticmethod
    def _row(key, run: tuple, expired: bool) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *run, expired)], columns=IMPROVEMENT_SCHEMA.fieldNames())
        return out.astype({f"delta_{m}": "float64" for m in IMPROVEMENT_METRICS})

    def close(self) -> None:
        pass


def improvement_changes(spark: SparkSession, results_dir: str, keep_ms: int | None = None, max_files_per_trigger: int = 64) -> DataFrame:
    """Changes of the improvement table as run results land: the model's new latest run, or that it expired."""
    results = spark.readStream.schema(RESULT_STREAM_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(results_dir)
    good = results.where((F.col("status") == "success") & F.col("model_id").isNotNull() & F.col("run_id").isNotNull())
    deltas = [F.col("metrics")[f"id.delta.{m}"].alias(f"delta_{m}") for m in IMPROVEMENT_METRICS]
    return good.select("model_id", "run_id", *deltas).groupBy("model_id").transformWithStateInPandas(
        LatestRun(keep_ms), IMPROVEMENT_SCHEMA, outputMode="Update", timeMode="None" if keep_ms is None else "ProcessingTime")


def improvement_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The improvement table (deltas as ``%+.4f``) from the changes that the stream has written."""
    changes = spark.read.schema(T.StructType([*IMPROVEMENT_SCHEMA.fields, T.StructField("epoch", T.LongType())])).parquet(out_dir)
    last = changes.groupBy("model_id").agg(F.max_by(F.struct(*IMPROVEMENT_SCHEMA.fieldNames()[1:]), "epoch").alias("r"))
    return last.where("not r.expired").select("model_id", *[signed(F.col(f"r.delta_{m}")).alias(f"delta_{m}") for m in IMPROVEMENT_METRICS])


def stream_improvement_table(spark: SparkSession, results_dir: str, checkpoint: str, out_dir: str,
                             available_now: bool = True, keep_ms: int | None = None, max_files_per_trigger: int = 64) -> StreamingQuery:
    """Keep the improvement table current as run results land; ``improvement_rows`` reads it.

    Each micro-batch writes its changes to a folder of its own (``epoch=N``), which a repeated batch overwrites.
    The state is one row per model; with ``keep_ms`` models without new results expire."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    own = _stream_session(spark, None)
    writer = (improvement_changes(own, results_dir, keep_ms, max_files_per_trigger).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()
