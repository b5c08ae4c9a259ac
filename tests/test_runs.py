import pytest
from pyspark.sql import functions as F

from tripleval.functions.models import size_category, size_category_numeric
from tripleval.operators import runs


@pytest.mark.parametrize("mid,cat", [("x/y-13b", "medium"), ("x/y-11b", "small"), ("x/y-32b", "medium"),
                                     ("x/y-500m", "small"), ("x/unknown", "unknown"), ("google/gemma-2-9b", "large"), ("google/gemma-2-2b-it", "medium"),
                                     ("01-ai/Yi-9B", "large"), ("TinyLlama/TinyLlama-1.1B-Chat-v1.0", "small")])
def test_size_category_substring_rule(spark, mid, cat):
    df = spark.createDataFrame([(mid,)], "model_id string")
    assert df.select(size_category(F.col("model_id"))).first()[0] == cat


@pytest.mark.parametrize("mid,cat", [("x/y-13b", "large"), ("x/y-500m", "small"), ("q/Qwen2.5-1.5B-Instruct", "small"),
                                     ("u/Meta-Llama-3.1-8B", "medium"), ("x/unknown", "unknown")])
def test_size_category_numeric(spark, mid, cat):
    df = spark.createDataFrame([(mid,)], "model_id string")
    assert df.select(size_category_numeric(F.col("model_id"))).first()[0] == cat


@pytest.mark.parametrize("spec,expect", [("all", ("all", None)), ("Small", ("size", "small")),
                                         ("0-3", ("range", (0, 3))), ("0,1,2", ("list", [0, 1, 2])),
                                         ("2 0 1", ("list", [0, 1, 2]))])
def test_parse_selection(spec, expect):
    assert runs.parse_selection(spec, 10) == expect


@pytest.mark.parametrize("spec", ["1-2-3", "0-10", "-1", "a,b", "", "3-1", "10"])
def test_parse_selection_rejects(spec):
    with pytest.raises(ValueError):
        runs.parse_selection(spec, 10)


def test_pending_and_missing(spark):
    models = spark.createDataFrame([(0, "a/x", "x"), (1, "a/y", None), (2, "a/z", "z")],
                                   "idx int, model_id string, output_dir string")
    run_log = spark.createDataFrame([("a/x", "success"), ("a/y", "failed")], "model_id string, status string")
    assert sorted(r.model_id for r in runs.pending_models(models, run_log).collect()) == ["a/y", "a/z"]
    assert [r.model_id for r in runs.missing_output_dirs(models, models).collect()] == ["a/y"]
    res = {r.model_id: r.resolved_dir for r in runs.resolve_output_dir(models.select("model_id"), models).collect()}
    assert res == {"a/x": "cache/models/x", "a/y": "cache/models/y_evaluation", "a/z": "cache/models/z"}
