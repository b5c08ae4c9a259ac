from pyspark.sql import functions as F

from tripleval.operators import explore, metrics
from tripleval.operators.numbering import rank_global
from tripleval.operators.split import seeded_split

TRIP = "triplet_id long, form string, observations string, question string, answer string"


def test_dataset_stats_empty_gives_nulls(spark):
    r = explore.dataset_stats(spark.createDataFrame([], TRIP)).first()
    assert r.total_triplets == 0 and r.avg_observation_length is None


def test_unique_forms_counts_missing_form(spark):
    df = spark.createDataFrame([(1, "a", "o", "q", "x"), (2, None, "o", "q", "x"), (3, "a", "o", "q", "x")], TRIP)
    assert explore.dataset_stats(df).first().unique_forms == 2


def test_empty_inputs_flow_through(spark):
    empty = spark.createDataFrame([], TRIP)
    assert seeded_split(empty, "triplet_id").count() == 0
    assert rank_global(empty, ["triplet_id"]).count() == 0
    preds = spark.createDataFrame([], "model_id string, variant string, distribution string, example_id long, "
                                      "prediction string, reference string")
    assert metrics.metric_bundle(preds).count() == 0
    assert explore.form_distribution(empty).count() == 0
    assert explore.page_slice(explore.number_items(empty), 1, 10).count() == 0
    assert explore.first_n(empty.where(F.col("form") == "x"), ["triplet_id"], 5).count() == 0
