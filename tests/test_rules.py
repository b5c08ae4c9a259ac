import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripleval.functions.models import error_preview, export_file_name, model_short_name, run_duration
from tripleval.operators import explore


def test_export_file_name_sanitises(spark):
    df = spark.createDataFrame([("a/b c",), (None,), ("en",)], "form string")
    got = [r[0] for r in df.select(export_file_name(F.col("form"), F.lit("json"))).collect()]
    assert got == ["ir_triplets_a_b_c.json", "ir_triplets_All.json", "ir_triplets_en.json"]


def test_error_preview_and_short_name(spark):
    df = spark.createDataFrame([("x" * 150, "org/some-model"), ("short", "plain")], "e string, m string")
    rows = df.select(error_preview(F.col("e")).alias("p"), model_short_name(F.col("m")).alias("s")).collect()
    assert rows[0].p == "x" * 100 + "..." and rows[1].p == "short..."
    assert [r.s for r in rows] == ["some-model", "plain"]


def test_run_duration_keeps_microseconds(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    df = spark.createDataFrame([(t0, t0 + dt.timedelta(seconds=857, microseconds=300000))],
                               "s timestamp_ntz, e timestamp_ntz")
    assert df.select(run_duration(F.col("s"), F.col("e"))).first()[0] == pytest.approx(857.3)


def test_page_size_must_be_offered():
    with pytest.raises(ValueError):
        explore.jump_to_page(F.lit(3), 7)
