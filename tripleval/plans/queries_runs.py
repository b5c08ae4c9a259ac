"""Registered queries: model registry, run log, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as fm
from ..operators import runs as ops
from ..operators.numbering import progress_index
from ..sources import fixtures
from .oracle import sql
from .registry import register

SPEC = "1-4"


def _runs(spark, d):
    return fixtures.runs(spark, d)


def _registry(spark, d):
    return fixtures.model_registry(spark, d)


@register("src_model_registry", sql("SELECT * FROM registry", "registry"))
def q_src_model_registry(spark, d):
    return _registry(spark, d)


@register("model_short_name", sql(f"SELECT run_id, model_id, {fm.sql_model_short_name('model_id')} AS short_name "
                                  "FROM runs", "runs"))
def q_model_short_name(spark, d):
    return _runs(spark, d).select("run_id", "model_id", fm.model_short_name(F.col("model_id")).alias("short_name"))


@register("size_category", sql(f"""SELECT model_id, {fm.sql_size_category('model_id')} AS size_category,
    {fm.sql_size_category_numeric('model_id')} AS size_category_numeric FROM registry""", "registry"))
def q_size_category(spark, d):
    return _registry(spark, d).select("model_id", fm.size_category(F.col("model_id")).alias("size_category"),
                                      fm.size_category_numeric(F.col("model_id")).alias("size_category_numeric"))


@register("filter_by_size", sql(f"SELECT * FROM registry WHERE {fm.sql_size_category('model_id')} = 'medium'",
                                "registry"))
def q_filter_by_size(spark, d):
    return ops.filter_by_size(_registry(spark, d), "medium")


@register("select_by_index", sql("SELECT * FROM registry WHERE idx BETWEEN 1 AND 4", "registry"))
def q_select_by_index(spark, d):
    reg = _registry(spark, d)
    n = reg.count()  # registry size bounds the spec check; one small action on the driver
    return ops.select_by_index(reg, SPEC, n)


@register("filter_by_status", sql("SELECT * FROM runs WHERE status = 'failed'", "runs"))
def q_filter_by_status(spark, d):
    return ops.filter_by_status(_runs(spark, d), "failed")


@register("resolve_output_dir", sql(f"""SELECT r.*, 'cache/models/' ||
    coalesce(g.output_dir, {fm.sql_model_short_name('r.model_id')} || '_evaluation') AS resolved_dir
    FROM runs r LEFT JOIN registry g USING (model_id)""", "runs", "registry"))
def q_resolve_output_dir(spark, d):
    return ops.resolve_output_dir(_runs(spark, d), _registry(spark, d))


@register("missing_output_dirs", sql("""SELECT DISTINCT model_id FROM runs
    WHERE model_id NOT IN (SELECT model_id FROM registry WHERE output_dir IS NOT NULL)""", "runs", "registry"))
def q_missing_output_dirs(spark, d):
    return ops.missing_output_dirs(_runs(spark, d), _registry(spark, d))


@register("pending_models", sql("""SELECT * FROM registry WHERE model_id NOT IN
    (SELECT model_id FROM runs WHERE status = 'success')""", "runs", "registry"))
def q_pending_models(spark, d):
    return ops.pending_models(_registry(spark, d), _runs(spark, d))


@register("run_status_counts", sql("""SELECT count(*) AS total_models,
    count(*) FILTER (WHERE status = 'success') AS successful,
    count(*) FILTER (WHERE status = 'failed') AS failed FROM runs""", "runs"))
def q_run_status_counts(spark, d):
    return ops.run_status_counts(_runs(spark, d))


@register("run_duration", sql(f"SELECT run_id, round({fm.sql_run_duration('started_at', 'ended_at')}, 6) AS seconds, "
                              f"round({fm.sql_run_duration('started_at', 'ended_at')} / 60.0, 6) AS minutes FROM runs",
                              "runs"))
def q_run_duration(spark, d):
    sec = fm.run_duration(F.col("started_at"), F.col("ended_at"))
    return _runs(spark, d).select("run_id", F.round(sec, 6).alias("seconds"), F.round(sec / 60.0, 6).alias("minutes"))


@register("error_preview", sql(f"SELECT run_id, {fm.sql_error_preview('error')} AS preview FROM runs "
                               "WHERE status = 'failed'", "runs"))
def q_error_preview(spark, d):
    return (ops.filter_by_status(_runs(spark, d), "failed")
            .select("run_id", fm.error_preview(F.col("error")).alias("preview")))


@register("progress_index", sql("""SELECT model_id, row_number() OVER (ORDER BY idx, model_id) AS i,
    count(*) OVER () AS n FROM registry""", "registry"))
def q_progress_index(spark, d):
    return progress_index(_registry(spark, d))


@register("param_totals", sql("""SELECT model_id, CAST(sum(numel) AS BIGINT) AS total_params,
    CAST(sum(CASE WHEN requires_grad THEN numel ELSE 0 END) AS BIGINT) AS trainable_params,
    round(CASE WHEN sum(numel) > 0 THEN 100.0 * sum(CASE WHEN requires_grad THEN numel ELSE 0 END) / sum(numel) END, 6)
        AS trainable_pct FROM params GROUP BY model_id""", "params"))
def q_param_totals(spark, d):
    return ops.param_totals(fixtures.parameters(spark, d))
