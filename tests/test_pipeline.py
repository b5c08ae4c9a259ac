import os
import tempfile

from pyspark.sql import functions as F

from tripleval.operators.bootstrap import rouge_bootstrap
from tripleval.plans.fleet import run_fleet
from tripleval.streaming.run_summary import stream_run_summary


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"model_id", "variant", "distribution", "metric", "value", "n_examples"}
    assert {r.metric for r in rows} == {"rouge1", "rouge2", "rougeL", "rougeLsum", "bleu"}


def test_registry_keys_cover_oracle(spark):
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 75


def test_stream_equals_batch_with_duplicates(spark):
    base = tempfile.mkdtemp(prefix="tripleval-stream-")
    rows = [(i, "m", "m", "failed" if i % 4 == 0 else "success") for i in range(40)]
    schema = "run_id long, model_id string, model_name string, status string"
    df = spark.createDataFrame(rows, schema).withColumn("started_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    for part in range(3):   # three landings; the second repeats rows of the first
        lo = 0 if part == 1 else part * 15
        df.where(F.col("run_id").between(lo, lo + 14)).write.mode("append").parquet(os.path.join(base, "runs"))
    q = stream_run_summary(spark, os.path.join(base, "runs"), os.path.join(base, "ckpt"), os.path.join(base, "out"),
                           max_files_per_trigger=1)
    q.awaitTermination()
    assert len(q.recentProgress) > 1            # several micro-batches, counts carried in state
    got = {r.status: r.n for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    landed = spark.read.parquet(os.path.join(base, "runs"))
    assert landed.count() > landed.dropDuplicates(["run_id"]).count()   # duplicates really landed
    batch = {r.status: r["count"] for r in landed.dropDuplicates(["run_id"]).groupBy("status").count().collect()}
    assert got == batch


def test_fleet_isolates_failures(spark):
    ex = spark.createDataFrame([(1, "train", "p", "r")], "example_id long, split string, prompt string, "
                                                          "response string")

    def predict(examples, model):
        if model == "bad":
            raise RuntimeError("x" * 150)
        return spark.createDataFrame([(model, "baseline", "id", 1, "a b", "a b")],
                                     "model_id string, variant string, distribution string, example_id long, "
                                     "prediction string, reference string")

    runs, metrics = run_fleet(spark, ex, ["good", "bad"], predict, tempfile.mkdtemp(prefix="tripleval-fleet-"))
    status = {r.model_id: r.status for r in runs.collect()}
    assert status == {"good": "success", "bad": "failed"}
    assert {r.model_id for r in metrics.collect()} == {"good"}


def test_bootstrap_brackets_mean(spark):
    rows = [("m", "b", "id", i, float(i % 10) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "model_id string, variant string, distribution string, example_id long, "
                                     "rouge1 double")
    r = rouge_bootstrap(df, ["example_id"], ["rouge1"], replicates=100).first()
    assert r.low <= r.mean <= r.high and abs(r.mid - r.mean) < 0.03
    again = rouge_bootstrap(df.repartition(3), ["example_id"], ["rouge1"], replicates=100).first()
    assert (again.low, again.mid, again.high) == (r.low, r.mid, r.high)


def test_pluggable_generator_matches_native_echo(spark):
    from tripleval.operators import generate as G
    inputs = spark.createDataFrame(
        [("id", 1, "obs line\nsecond", "What follows?", "ref"), ("od", 2, "x", "  q two  ", "r")],
        "distribution string, example_id long, observations string, question string, reference string")

    def factory():
        def fn(batch):   # a causal-LM-like echo: prompt + question words + end mark
            return batch["prompt"] + batch["question"].str.split().str[:64].str.join(" ") + "\n<|end|>"
        return fn

    plug = G.to_predictions(G.generate_with(inputs, "echo", factory), "baseline")
    native = G.to_predictions(G.generate_native(inputs, ["echo"]), "baseline")
    assert sorted(map(tuple, plug.collect())) == sorted(map(tuple, native.collect()))


def test_src_csv_reads_pandas_na_tokens(spark):
    from pyspark.sql import types as T

    from tripleval.sinks.writers import sink_csv
    from tripleval.sources.files import src_csv
    path = tempfile.mkdtemp(prefix="tripleval-csv-")
    df = spark.createDataFrame([(1, "NA", 'say "hi"\nline'), (2, None, "")], "id long, a string, b string")
    sink_csv(df, path + "/t")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()),
                           T.StructField("b", T.StringType())])
    got = sorted(tuple(r) for r in src_csv(spark, path + "/t", schema).collect())
    assert got == [(1, None, 'say "hi"\nline'), (2, None, None)]


def test_fleet_rerun_is_idempotent(spark):
    ex = spark.createDataFrame([(1, "train", "p", "r")], "example_id long, split string, prompt string, "
                                                          "response string")

    def predict(examples, model):
        return spark.createDataFrame([(model, "baseline", "id", 1, "a b", "a b")],
                                     "model_id string, variant string, distribution string, example_id long, "
                                     "prediction string, reference string")

    path = tempfile.mkdtemp(prefix="tripleval-fleet-")
    run_fleet(spark, ex, ["m1", "m2"], predict, path)
    run_fleet(spark, ex, ["m2"], predict, path)          # resume / repeat of one model
    counts = {r.model_id: r["count"] for r in spark.read.parquet(f"{path}/predictions").groupBy("model_id").count().collect()}
    assert counts == {"m1": 1, "m2": 1}


def test_stream_improvement_table_equals_batch(spark, sf_dir):
    from tripleval.operators.compare import improvement_table
    from tripleval.plans import evaluate as ev
    from tripleval.streaming.run_summary import improvement_rows, metrics_map, stream_improvement_table
    comparison = ev.evaluate_models(ev.examples(spark, sf_dir)).comparison
    mm = metrics_map(comparison)
    base = tempfile.mkdtemp(prefix="tripleval-impr-")
    res = os.path.join(base, "results")
    # landing 1: an older run of every model with wrong (stale) metrics and a failed run
    stale = mm.select(F.lit(1).cast("long").alias("run_id"), "model_id", F.lit("success").alias("status"),
                      F.map_from_arrays(F.array(F.lit("id.delta.bleu")), F.array(F.lit(-99.0))).alias("metrics"))
    stale.write.mode("append").json(res)
    # landing 2: the real runs; landing 3: a later failed run that must not replace them
    mm.select(F.lit(2).cast("long").alias("run_id"), "model_id", F.lit("success").alias("status"),
              "metrics").write.mode("append").json(res)
    mm.select(F.lit(3).cast("long").alias("run_id"), "model_id", F.lit("failed").alias("status"),
              F.lit(None).cast("map<string,double>").alias("metrics")).write.mode("append").json(res)
    q = stream_improvement_table(spark, res, os.path.join(base, "ckpt"), os.path.join(base, "out"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in improvement_rows(spark, os.path.join(base, "out")).collect())
    expect = sorted(tuple(r) for r in improvement_table(comparison).collect())
    assert got == expect


def _fleet_examples(spark):
    return spark.createDataFrame([(1, "train", "p", "r")], "example_id long, split string, prompt string, response string")


def test_fleet_resumes_models_without_success(spark):
    from tripleval.plans.fleet import recorded_runs
    calls = []

    def predict(examples, model):
        calls.append(model)
        if model == "flaky" and calls.count("flaky") == 1:
            raise RuntimeError("first try")
        return spark.createDataFrame([(model, "baseline", "id", 1, "a b", "a b")],
                                     "model_id string, variant string, distribution string, example_id long, "
                                     "prediction string, reference string")

    path = tempfile.mkdtemp(prefix="tripleval-fleet-")
    models = ["one", "flaky", "two"]
    runs, _ = run_fleet(spark, _fleet_examples(spark), models, predict, path, resume=True)
    assert {r.model_id: r.status for r in runs.collect()} == {"one": "success", "flaky": "failed", "two": "success"}
    runs, metrics = run_fleet(spark, _fleet_examples(spark), models, predict, path, resume=True)
    assert calls == ["one", "flaky", "two", "flaky"]          # finished models are not run again
    assert {r.model_id: r.status for r in runs.collect()} == dict.fromkeys(models, "success")
    assert {r.model_id for r in metrics.collect()} == set(models)
    assert recorded_runs(spark, path).count() == 4


def test_own_generators_and_metrics_in_the_evaluation(spark, sf_dir):
    from tripleval.plans import evaluate as ev
    from tripleval.plans.queries_core import _echo_factory
    ex = ev.examples(spark, sf_dir)
    exact = {"exact": lambda p, r: (p == r).cast("double"), "length": lambda p, r: F.length(p)}
    e = ev.evaluate_models(ex, ["echo", "mine"], generators={"mine": _echo_factory}, scorers=exact)
    rows = {(r.model_id, r.variant, r.distribution, r.metric): r.value for r in e.metrics.collect()}
    assert {k[3] for k in rows} == {"rouge1", "rouge2", "rougeL", "rougeLsum", "bleu", "exact", "length"}
    for (model, *rest), value in rows.items():                # the own model says what the native one says
        assert rows[("echo", *rest)] == value


def test_stream_counts_late_landings_and_reports_dropped_ones(spark):
    from tripleval.streaming.run_summary import late_rows
    base = tempfile.mkdtemp(prefix="tripleval-late-")
    schema = "run_id long, model_id string, model_name string, status string"
    for k, day in enumerate([20, 19, 1, 2, 25]):               # not in time order
        (spark.createDataFrame([(k, "m", "m", "success")], schema)
         .withColumn("started_at", F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp_ntz"))
         .coalesce(1).write.mode("append").parquet(f"{base}/runs"))
    q = stream_run_summary(spark, f"{base}/runs", f"{base}/c1", f"{base}/o1", max_files_per_trigger=1)
    q.awaitTermination()
    assert [(r.status, r.n) for r in spark.read.parquet(f"{base}/o1").collect()] == [("success", 5)]
    q = stream_run_summary(spark, f"{base}/runs", f"{base}/c2", f"{base}/o2", max_files_per_trigger=1, watermark="1 day")
    q.awaitTermination()
    kept = sum(r.n for r in spark.read.parquet(f"{base}/o2").collect())
    assert late_rows(q) > 0 and kept + late_rows(q) == 5


def test_improvement_stream_in_any_order_and_expiry(spark):
    """Shuffled, late and repeated landings, a correction, failed runs; a second start; models that expire."""
    import random
    import time

    from tripleval.streaming.run_summary import RESULT_STREAM_SCHEMA, improvement_rows, stream_improvement_table
    runs = [(i, f"m{i % 4}", "failed" if i % 5 == 0 else "success", {"id.delta.rouge1": i / 100, "id.delta.bleu": -i / 10}) for i in range(24)]
    runs += [(23, "m3", "success", {"id.delta.rouge1": 9.0, "id.delta.bleu": 1.0}), (1, "late", "success", {}), (2, "gone", "failed", {})]
    landings = runs + runs[:9]
    random.Random(4).shuffle(landings)
    base = tempfile.mkdtemp(prefix="tripleval-impr-")
    res, ckpt, out = (os.path.join(base, x) for x in ("results", "ckpt", "out"))
    for part in range(3):
        spark.createDataFrame(landings[part::4], RESULT_STREAM_SCHEMA).coalesce(1).write.mode("append").json(res)
    stream_improvement_table(spark, res, ckpt, out, max_files_per_trigger=1).awaitTermination()
    spark.createDataFrame(landings[3::4], RESULT_STREAM_SCHEMA).coalesce(1).write.mode("append").json(res)
    stream_improvement_table(spark, res, ckpt, out, max_files_per_trigger=1).awaitTermination()     # goes on from its checkpoint
    best = {}
    for run_id, model, status, metrics in runs:
        deltas = tuple(metrics.get(f"id.delta.{m}") for m in ("rouge1", "rougeL", "bleu"))
        if status == "success":
            best[model] = max(best.get(model, (-1, ())), (run_id, tuple((v is not None, v or 0.0) for v in deltas)))
    want = {m: tuple(f"{v:+.4f}" if there else None for there, v in r[1]) for m, r in best.items()}
    assert {r[0]: tuple(r)[1:] for r in improvement_rows(spark, out).collect()} == want and len(want) == 5

    q = stream_improvement_table(spark, res, os.path.join(base, "ckpt2"), os.path.join(base, "out2"), available_now=False, keep_ms=1500)
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(2)
            if os.path.isdir(os.path.join(base, "out2")) and q.lastProgress and q.lastProgress["batchId"] > 1 \
                    and improvement_rows(spark, os.path.join(base, "out2")).isEmpty():
                break
        assert improvement_rows(spark, os.path.join(base, "out2")).isEmpty()        # every model has expired
    finally:
        q.stop()


def test_join_of_predictions_and_inputs_loses_no_row(spark):
    import pytest
    from pyspark.errors import PySparkException

    from tripleval.operators import generate as G
    inputs = spark.createDataFrame([("id", 1, "o", "q", "r"), ("id", 2, "o", "q", "r")],
                                   "distribution string, example_id long, observations string, question string, reference string")
    whole = spark.createDataFrame([("m", "baseline", "id", 1, "p"), ("m", "baseline", "id", 2, "p")],
                                  "model_id string, variant string, distribution string, example_id long, prediction string")
    assert G.join_predictions_references(whole, inputs).count() == 2
    lost = whole.where("example_id = 1").union(spark.createDataFrame([("m", "baseline", "od", 7, "p")], whole.schema))
    kept = G.join_predictions_references(lost, inputs, unmatched="keep").collect()
    assert sorted((r.model_id is None, r.reference is None, r.example_id) for r in kept) == [(False, False, 1), (False, True, 7), (True, False, 2)]
    assert tuple(G.unmatched_counts(lost, inputs).first()) == (1, 1)
    for part, said in ((lost.where("example_id = 7").union(whole), "no input"), (whole.limit(1), "no prediction")):
        with pytest.raises(PySparkException, match=said):
            G.join_predictions_references(part, inputs).count()
