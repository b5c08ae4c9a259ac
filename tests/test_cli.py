import os
import tempfile

from pyspark.sql import functions as F

from tripleval import cli
from tripleval.sinks import writers
from tripleval.sources import fixtures


def _inputs(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="tripleval-cli-")
    writers.export_json(fixtures.id_triplets(spark, sf_dir), None, f"{base}/triplets")
    f = fixtures.facts(spark, sf_dir)
    cols = ["fact_id", *fixtures.FACT_COLS, "rule template", "rule type", "rule"]
    paths = []
    for split in ("test", "train", "val"):
        writers.sink_csv(f.where(F.col("file_split") == split).select(*[F.col(f"`{c}`") for c in cols]),
                         f"{base}/facts_{split}")
        paths.append(f"{split}={base}/facts_{split}")
    return base, ",".join(paths)


def test_cli_evaluate_fleet_explore(spark, sf_dir, capsys):
    base, facts = _inputs(spark, sf_dir)
    assert cli.main(["evaluate", "--triplets", f"{base}/triplets", "--facts", facts, "--out", f"{base}/ev"],
                    spark) == 0
    preds = spark.read.json(f"{base}/ev/predictions")
    assert preds.count() > 0 and os.path.isdir(f"{base}/ev/metrics")
    assert cli.main(["fleet", "--triplets", f"{base}/triplets", "--facts", facts, "--select", "0-1",
                     "--out", f"{base}/fl"], spark) == 0
    header = spark.read.json(f"{base}/fl/batch_summary/header").first()
    assert header.total_models == 2 and header.successful == 2
    for what in ["stats", "distribution", "lengths", "forms"]:
        assert cli.main(["explore", "--triplets", f"{base}/triplets", what], spark) == 0
    assert cli.main(["explore", "--triplets", f"{base}/triplets", "page", "--page", "2", "--size", "5"], spark) == 0
    assert cli.main(["explore", "--triplets", f"{base}/triplets", "export", "--format", "md", "--form", "en",
                     "--out", f"{base}/md"], spark) == 0
    md = "".join(open(os.path.join(f"{base}/md", p)).read() for p in sorted(os.listdir(f"{base}/md"))
                 if p.startswith("part-"))
    assert md.startswith("# IR-Triplet Export: en\n") and "\n## Triplet 1\n" in md
    assert cli.main(["output-dirs", "--models", "a/x,a/y", "--dirs", "a/x=xd"], spark) == 0
    out = capsys.readouterr().out
    assert "cache/models/xd" in out and "cache/models/y_evaluation" in out


def test_cli_fleet_results_feed_improvement_stream(spark, sf_dir):
    from tripleval.streaming.run_summary import improvement_rows, stream_improvement_table
    base, facts = _inputs(spark, sf_dir)
    assert cli.main(["fleet", "--triplets", f"{base}/triplets", "--facts", facts, "--out", f"{base}/fl"], spark) == 0
    results = spark.read.json(f"{base}/fl/batch_summary/results")
    assert results.where("metrics is not null").count() == 3
    q = stream_improvement_table(spark, f"{base}/fl/batch_summary/results", f"{base}/ck", f"{base}/impr")
    q.awaitTermination()
    rows = improvement_rows(spark, f"{base}/impr").collect()
    assert len(rows) == 3 and all(r.delta_bleu.startswith(("+", "-")) for r in rows)


def test_cli_evaluate_baseline_only_still_writes_summary(spark, sf_dir):
    from tripleval.sources.files import METRICS_SUMMARY_SCHEMA
    base, facts = _inputs(spark, sf_dir)
    assert cli.main(["evaluate", "--triplets", f"{base}/triplets", "--facts", facts, "--skip-finetuning",
                     "--models", "lead", "--out", f"{base}/ev"], spark) == 0
    preds = spark.read.json(f"{base}/ev/predictions")
    assert {r.variant for r in preds.select("variant").distinct().collect()} == {"baseline"}
    summary = spark.read.schema(METRICS_SUMMARY_SCHEMA).json(f"{base}/ev/metrics").first()
    assert summary.in_distribution.baseline.rouge1 is not None
    assert summary.in_distribution.finetuned.rouge1 is None and summary.out_of_distribution is None


def test_cli_fleet_writes_to_the_registry_folders_with_spectra(spark, sf_dir, capsys):
    from tripleval.operators.generate import NATIVE_GENERATORS
    from tripleval.sources import fixtures
    from tripleval.sources.files import METRICS_SUMMARY_SCHEMA, src_batch_summary_documents
    base, facts = _inputs(spark, sf_dir)
    fixtures.generator_weights(spark, sf_dir, NATIVE_GENERATORS).write.parquet(f"{base}/weights")
    assert cli.main(["fleet", "--triplets", f"{base}/triplets", "--facts", facts, "--models", "lead,echo", "--dirs", "lead=first_line",
                     "--base", f"{base}/models", "--max-new-words", "3", "--weights", f"{base}/weights", "--out", f"{base}/fl"], spark) == 0
    assert sorted(os.listdir(f"{base}/models")) == ["echo_evaluation", "first_line"]
    words = spark.read.json(f"{base}/models/first_line/predictions").where("variant = 'baseline'").select("Prediction").collect()
    assert words and max(len(r[0].split()) for r in words) == 3
    docs = {r.model_id: r for r in src_batch_summary_documents(spark, f"{base}/fl/summary").collect()}
    assert docs["lead"].output_dir == f"{base}/models/first_line"
    assert "alpha_weighted" in docs["echo"].metrics.weightwatcher.changes
    summary = spark.read.schema(METRICS_SUMMARY_SCHEMA).json(f"{base}/fl/metrics").collect()
    assert all(set(r.weightwatcher.changes) == set(r.weightwatcher.baseline) for r in summary)
    assert "alpha_weighted_delta" in capsys.readouterr().out


def test_model_registry_from_list_and_map(spark):
    import pytest

    from tripleval.sources.files import src_model_registry
    got = src_model_registry(spark, ["b/x", "a/y", "b/x"], {"a/y": "why"}).collect()
    assert [tuple(r) for r in got] == [(0, "b/x", None), (1, "a/y", "why")]
    with pytest.raises(ValueError):
        src_model_registry(spark, ["a"], {"b": "dir"})
    assert src_model_registry(spark, []).collect() == []
