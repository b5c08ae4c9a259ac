"""Registered queries: dataset-explorer questions over the ID triplets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore
from ..operators.numbering import rank_global
from ..sources import fixtures
from .oracle import sql
from .registry import register

TRIP = ["triplet_id", "form", "observations", "question", "answer"]
PAGE, PAGE_SIZE = 3, 25
FORM = "en"
FIRST_N = 10
JUMP_SIZE = 10


def _trip(spark, d):
    return fixtures.id_triplets(spark, d)


@register("dataset_stats", sql("""SELECT count(*) AS total_triplets,
    count(DISTINCT form) + max(CASE WHEN form IS NULL THEN 1 ELSE 0 END) AS unique_forms,
    round(avg(length(observations)), 6) AS avg_observation_length,
    round(avg(length(question)), 6) AS avg_question_length,
    round(avg(length(answer)), 6) AS avg_answer_length FROM id_trip""", "id_trip"))
def q_dataset_stats(spark, d):
    return explore.dataset_stats(_trip(spark, d))


@register("form_distribution", sql("""SELECT form, count(*) AS n,
    round(count(*) * 100.0 / (SELECT count(*) FROM id_trip), 1) AS pct FROM id_trip GROUP BY form""", "id_trip"))
def q_form_distribution(spark, d):
    return explore.form_distribution(_trip(spark, d))


@register("length_table", sql("""SELECT * FROM (
    SELECT 'Observation' AS field, CAST(floor(avg(length(observations))) AS BIGINT) AS avg_len FROM id_trip
    UNION ALL SELECT 'Question', CAST(floor(avg(length(question))) AS BIGINT) FROM id_trip
    UNION ALL SELECT 'Answer', CAST(floor(avg(length(answer))) AS BIGINT) FROM id_trip)""", "id_trip"))
def q_length_table(spark, d):
    return explore.length_table(_trip(spark, d))


@register("sorted_forms", sql("""SELECT 1 AS position, 'All' AS form UNION ALL
    SELECT row_number() OVER (ORDER BY form) + 1, form FROM (SELECT DISTINCT form FROM id_trip WHERE form IS NOT NULL)""",
                              "id_trip"))
def q_sorted_forms(spark, d):
    return explore.sorted_forms(_trip(spark, d))


@register("filter_by_form", sql(f"SELECT {', '.join(TRIP)} FROM id_trip WHERE form = '{FORM}'", "id_trip"))
def q_filter_by_form(spark, d):
    return explore.filter_by_form(_trip(spark, d), FORM).select(*TRIP)


@register("rank_global", sql("SELECT triplet_id, form, row_number() OVER (ORDER BY triplet_id) AS item FROM id_trip",
                             "id_trip"))
def q_rank_global(spark, d):
    return rank_global(_trip(spark, d).select("triplet_id", "form"), ["triplet_id"], rank_col="item")


@register("page_slice", sql(f"""SELECT {', '.join(TRIP)}, item, n AS total,
    CAST({(PAGE - 1) * PAGE_SIZE + 1} AS BIGINT) AS first_item, least({PAGE * PAGE_SIZE}, n) AS last_item,
    CAST(floor((n - 1) / {PAGE_SIZE}) + 1 AS BIGINT) AS pages
    FROM (SELECT *, row_number() OVER (ORDER BY triplet_id) AS item, count(*) OVER () AS n FROM id_trip)
    WHERE item BETWEEN {(PAGE - 1) * PAGE_SIZE + 1} AND {PAGE * PAGE_SIZE}""", "id_trip"))
def q_page_slice(spark, d):
    return explore.page_slice(_trip(spark, d).select(*TRIP), PAGE, PAGE_SIZE)


@register("jump_to_page", sql(f"""SELECT triplet_id, item, CAST(floor((item - 1) / {JUMP_SIZE}) + 1 AS BIGINT) AS page
    FROM (SELECT triplet_id, row_number() OVER (ORDER BY triplet_id) AS item FROM id_trip)""", "id_trip"))
def q_jump_to_page(spark, d):
    numbered = explore.number_items(_trip(spark, d).select("triplet_id"))
    return numbered.select("triplet_id", "item",
                           explore.jump_to_page(F.col("item"), JUMP_SIZE).cast("bigint").alias("page"))


@register("first_n", sql(f"""SELECT {', '.join(TRIP)}, total, least({FIRST_N}, total) AS shown FROM
    (SELECT *, count(*) OVER () AS total FROM id_trip WHERE form = 'de') ORDER BY triplet_id LIMIT {FIRST_N}""",
                         "id_trip"))
def q_first_n(spark, d):
    return explore.first_n(explore.filter_by_form(_trip(spark, d), "de").select(*TRIP), ["triplet_id"], FIRST_N)
