"""Readers accept summaries in the pretty-printed document layout of existing runs."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tripleval.sources.files import src_batch_summary_documents, src_metric_files

BLOCK = {"rouge1": 0.41, "rouge2": 0.13, "rougeL": 0.32, "rougeLsum": 0.37, "bleu": 9.5}
FT = {"rouge1": 0.52, "rouge2": 0.21, "rougeL": 0.44, "rougeLsum": 0.46, "bleu": 14.25}


def _delta(a, b):
    return {k: b[k] - a[k] for k in a}


def test_batch_summary_document(spark):
    doc = {"timestamp": "2031-02-03T04:05:06", "total_models": 2, "successful": 1, "failed": 1,
           "results": [
               {"model_id": "acme/tiny-0.5b", "model_name": "tiny-0.5b", "status": "success",
                "duration_seconds": 61.5, "output_dir": "cache/models/tiny",
                "metrics": {"in_distribution": {"baseline": BLOCK, "finetuned": FT, "improvements": _delta(BLOCK, FT)},
                            "out_of_distribution": None}},
               {"model_id": "x/y-7b", "model_name": "y-7b", "status": "failed", "error": "E" * 120,
                "output_dir": "N/A"}]}
    d = tempfile.mkdtemp(prefix="tripleval-doc-")
    with open(os.path.join(d, "batch_summary.json"), "w") as f:
        json.dump(doc, f, indent=2)
    rows = {r.model_id: r for r in src_batch_summary_documents(spark, d).collect()}
    assert rows["acme/tiny-0.5b"].metrics.in_distribution.improvements.bleu == FT["bleu"] - BLOCK["bleu"]
    assert rows["x/y-7b"].status == "failed" and rows["x/y-7b"].metrics is None
    ok = src_batch_summary_documents(spark, d).where(F.col("status") == "success")
    assert ok.select("metrics.in_distribution.finetuned.rouge1").first()[0] == FT["rouge1"]


def test_pretty_metric_summary_files(spark):
    base = tempfile.mkdtemp(prefix="tripleval-ms-")
    for model in ("m_a", "m_b"):
        os.makedirs(os.path.join(base, model))
        with open(os.path.join(base, model, "metrics_summary.json"), "w") as f:
            json.dump({"timestamp": "t", "in_distribution": {"baseline": BLOCK, "finetuned": FT,
                                                             "improvements": _delta(BLOCK, FT)}}, f, indent=2)
    rows = src_metric_files(spark, f"{base}/*/metrics_summary.json").collect()
    assert len(rows) == 2 * 2 * 5
    got = {(r.model_dir, r.variant, r.metric): r.value for r in rows}
    assert got[("m_b", "finetuned", "bleu")] == FT["bleu"] and got[("m_a", "baseline", "rouge2")] == BLOCK["rouge2"]


def test_triplet_json_array_without_ids(spark):
    from tripleval.sources.files import src_triplets_json
    d = tempfile.mkdtemp(prefix="tripleval-arr-")
    recs = [{"form": "f1", "Training Observations": f"obs {i}\nline", "Question": f"q{i}", "Answer": f"a{i}"}
            for i in range(7)]
    with open(os.path.join(d, "ir_triplets.json"), "w") as f:
        json.dump(recs, f, indent=2)
    rows = src_triplets_json(spark, d, multi_line=True).orderBy("triplet_id").collect()
    assert [r.triplet_id for r in rows] == list(range(7))
    assert [r.question for r in rows] == [f"q{i}" for i in range(7)]
    assert rows[3].observations == "obs 3\nline"


def _write(folder: str, name: str, text: str) -> None:
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_json_lines_without_ids_are_numbered_and_kept(spark):
    from tripleval.operators.split import seeded_split
    from tripleval.sources.files import sound_records, src_triplets_json
    d = tempfile.mkdtemp(prefix="tripleval-lines-")
    lines = [json.dumps({"form": "f", "Training Observations": f"o{i}", "Question": "q", "Answer": "a"}) for i in range(10)]
    _write(d, "a.json", "\n".join([*lines[:4], '{"form": broken', *lines[4:]]) + "\n")
    records, bad = sound_records(src_triplets_json(spark, d))
    assert bad == 1
    got = records.orderBy("triplet_id").collect()
    assert [r.triplet_id for r in got] == list(range(10)) and [r.observations for r in got] == [f"o{i}" for i in range(10)]
    split = seeded_split(records, "triplet_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 7, "id_val": 3}


def test_malformed_array_file_is_reported(spark):
    from tripleval.sources.files import sound_records, src_triplets_json
    d = tempfile.mkdtemp(prefix="tripleval-array-")
    _write(d, "good.json", json.dumps([{"form": "f", "Training Observations": "o", "Question": "q", "Answer": "a"}] * 3))
    _write(d, "bad.json", '[{"form": "f", ')
    records = src_triplets_json(spark, d, multi_line=True)
    assert [r._corrupt_record for r in records.collect() if r._corrupt_record] == ['[{"form": "f", ']
    sound, bad = sound_records(records)
    assert bad == 1 and sorted(r.triplet_id for r in sound.collect()) == [0, 1, 2]


def test_split_refuses_a_null_id(spark):
    import pytest

    from tripleval.operators.split import seeded_split
    df = spark.createDataFrame([(1,), (None,)], "triplet_id long")
    with pytest.raises(Exception, match="must not be null"):
        seeded_split(df, "triplet_id").collect()


def test_csv_keeps_white_space_and_empty_texts(spark):
    from pyspark.sql import types as T

    from tripleval.sinks.writers import sink_csv
    from tripleval.sources.files import src_csv
    texts = ["  lead and trail  ", "\tt", "", "a,\"b\"\nc", "NA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    path = tempfile.mkdtemp(prefix="tripleval-csv-") + "/x"
    sink_csv(df, path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    assert {r.id: r.t for r in src_csv(spark, path, schema, na_values=()).collect()} == dict(enumerate(texts))
    assert {r.id: r.t for r in src_csv(spark, path, schema).collect()} == {0: texts[0], 1: texts[1], 2: None, 3: texts[3], 4: None}


def test_metric_summaries_of_alike_names_stay_apart(spark):
    from tripleval.sinks.writers import sink_metrics_summary
    rows = [(m, "id", k, 0.1 * n, 0.2 * n, 0.1 * n) for n, m in enumerate(["a/b", "a_b", "plain"], 1) for k in ("rouge1", "bleu")]
    comparison = spark.createDataFrame(rows, "model_id string, distribution string, metric string, baseline double, finetuned double, delta double")
    path = tempfile.mkdtemp(prefix="tripleval-alike-") + "/x"
    sink_metrics_summary(comparison, path)
    got = {(r.model_dir, r.metric, r.variant): round(r.value, 6) for r in src_metric_files(spark, f"{path}/*/*.json").collect()}
    assert got == {(m, k, v): round(x, 6) for m, _, k, b, f, _ in rows for v, x in (("baseline", b), ("finetuned", f))}


def test_missing_delta_and_empty_table(spark):
    from tripleval.operators.compare import improvement_table
    from tripleval.operators.explore import dataset_stats
    comparison = spark.createDataFrame([("m", "id", "bleu", 1.0, None, None)],
                                       "model_id string, distribution string, metric string, baseline double, finetuned double, delta double")
    r = improvement_table(comparison).first()
    assert (r.delta_rouge1, r.delta_rougeL, r.delta_bleu) == (None, None, None)
    empty = spark.createDataFrame([], "form string, observations string, question string, answer string")
    assert tuple(dataset_stats(empty).first())[:2] == (0, 0)


def test_every_document_sentence_and_turn_arrives(spark, sf_dir):
    from tripleval.sources import fixtures
    from tripleval.sources.tables import table
    docs, trip = table(spark, sf_dir, "documents"), fixtures.id_triplets(spark, sf_dir)
    assert trip.count() == docs.count()
    lines = {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in docs.collect()}
    for r in trip.collect():
        assert "\n".join(x for x in (r.observations, r.answer) if x) == "\n".join(lines[r.triplet_id])
    for r in fixtures.facts(spark, sf_dir).join(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "fact_id"), "fact_id").collect():
        said = [r[c] for c in [*fixtures.FACT_COLS, "rule"] if r[c] is not None]
        letters = lambda t: [ch for ch in t if ch.isalnum()]
        assert letters("".join(said)) == letters(r.text)
    turns = {}
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append(r.text)
    got = {r.triplet_id: r for r in fixtures.conversation_triplets(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        r = got[conv]
        assert [r.observations, r.question, r.answer] == ["\n".join(said[:-2]), said[-2] if len(said) > 1 else "", said[-1]]
