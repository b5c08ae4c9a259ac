"""Pipeline input tables derived from the given test tables.

These only put rows into the schemas the operators expect (triplets, fact
files, weights, runs, parameters); all work of the pipeline happens in the
operators.  Each builder has a DuckDB twin (``*_SQL``) used by the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import model_short_name, sql_model_short_name
from ..functions.text import non_blank_lines, sql_non_blank_lines
from .tables import table

# The fact columns of the fact file format.
FACT_COLS = ["fact 1.1", "fact 1.2", "fact 2.1", "fact 2.2", "fact 3.1", "fact 3.2"]
SENTENCE_SPLIT = r"\.\s*"


# ---------------------------------------------------------------- triplets (ID)
def id_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> triplets, one per document: the answer is the last non-blank line, the observations
    are all before it (none, for a document of one line)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", spread=True)
    lines = non_blank_lines(F.coalesce(F.col("text"), F.lit("")))
    return (d.select("doc_id", "lang", "source", lines.alias("lines"))
            .select(F.col("doc_id").alias("triplet_id"),
                    F.lit("id").alias("dataset"),
                    F.col("lang").alias("form"),
                    F.array_join(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))), "\n")
                    .alias("observations"),
                    F.concat(F.lit("What follows for source "), F.col("source"), F.lit("?")).alias("question"),
                    F.coalesce(F.get("lines", F.size("lines") - 1), F.lit("")).alias("answer")))


ID_TRIPLETS_SQL = f"""
SELECT doc_id AS triplet_id, 'id' AS dataset, lang AS form,
       array_to_string(list_slice(lines, 1, len(lines) - 1), chr(10)) AS observations,
       'What follows for source ' || source || '?' AS question,
       coalesce(lines[len(lines)], '') AS answer
FROM (SELECT doc_id, lang, source, {sql_non_blank_lines("coalesce(text, '')")} AS lines FROM documents)
"""


# ---------------------------------------------------------------- fact table (OD)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark -> fact table: the last sentence is the rule, those before it are the facts.

    Sentences past the last fact column are joined into it.  Rows of the file ``val``, which has
    no column ``fact 3.2``, end with ``fact 3.1``.
    """
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    sents = F.filter(F.split(F.col("text"), SENTENCE_SPLIT), lambda s: s != F.lit(""))
    s = b.select("item_id", sents.alias("s"))
    n = F.size("s")
    last = F.when(F.pmod("item_id", F.lit(3)) == 2, len(FACT_COLS) - 1).otherwise(len(FACT_COLS))
    cols = [F.col("item_id").alias("fact_id"),
            F.when(F.pmod("item_id", F.lit(3)) == 0, "test").when(F.pmod("item_id", F.lit(3)) == 1, "train")
            .otherwise("val").alias("file_split")]
    for k, name in enumerate(FACT_COLS, start=1):
        rest = F.array_join(F.slice("s", F.lit(k), F.greatest(n - k, F.lit(0))), ". ")
        cols.append(F.when((n > k) & (last > k), F.get("s", F.lit(k - 1))).when((n > k) & (last == k), rest).alias(name))
    cols += [F.concat(F.lit("template"), F.pmod("item_id", F.lit(4)).cast("string")).alias("rule template"),
             F.concat(F.lit("type"), F.pmod("item_id", F.lit(3)).cast("string")).alias("rule type"),
             F.when(n > 0, F.element_at("s", -1)).alias("rule")]
    return s.select(*cols)


def _sql_facts() -> str:
    fact_cols = ",\n       ".join(
        f"CASE WHEN len(s) > {k} AND last > {k} THEN s[{k}] "
        f"WHEN len(s) > {k} AND last = {k} THEN array_to_string(list_slice(s, {k}, len(s) - 1), '. ') END AS \"{name}\""
        for k, name in enumerate(FACT_COLS, start=1))
    return f"""
SELECT item_id AS fact_id,
       CASE item_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS file_split,
       {fact_cols},
       'template' || CAST(item_id % 4 AS VARCHAR) AS "rule template",
       'type' || CAST(item_id % 3 AS VARCHAR) AS "rule type",
       CASE WHEN len(s) > 0 THEN s[len(s)] END AS rule
FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '{SENTENCE_SPLIT}'), lambda x: x <> '') AS s,
             CASE WHEN item_id % 3 = 2 THEN {len(FACT_COLS) - 1} ELSE {len(FACT_COLS)} END AS last
      FROM benchmark)
"""


FACTS_SQL = _sql_facts()


# ---------------------------------------------------------------- conversation triplets
def conversation_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triplet per conversation, under its id: the last turn is the answer, the one before it
    the question, all earlier turns are the observations (equal turn numbers: by role, then text).

    A conversation becomes one row, so its turns are collected once, in linear time.
    """
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", spread=True)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    texts = F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["text"])
    n = F.size("texts")
    return (c.groupBy("conv_id").agg(texts.alias("texts"))
            .select(F.col("conv_id").alias("triplet_id"),
                    F.lit("conv").alias("dataset"),
                    F.concat(F.lit("turns_"), n.cast("string")).alias("form"),
                    F.array_join(F.slice("texts", F.lit(1), F.greatest(n - 2, F.lit(0))), "\n").alias("observations"),
                    F.coalesce(F.get("texts", n - 2), F.lit("")).alias("question"),
                    F.get("texts", n - 1).alias("answer")))


CONV_TRIPLETS_SQL = """
SELECT conv_id AS triplet_id, 'conv' AS dataset, 'turns_' || CAST(len(t) AS VARCHAR) AS form,
       array_to_string(t[1:greatest(len(t) - 2, 0)], chr(10)) AS observations,
       CASE WHEN len(t) > 1 THEN t[len(t) - 1] ELSE '' END AS question, t[len(t)] AS answer
FROM (SELECT conv_id, list(coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
      FROM conversations GROUP BY conv_id)
"""


# ---------------------------------------------------------------- weight matrices
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> weight rows: label picks (model, layer); finetuned halves the even rows.

    Both variants come from one scan (variant is a generated column)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    vals = F.col("embedding").cast("array<double>")
    rows = e.withColumn("variant", F.explode(F.array(F.lit("baseline"), F.lit("finetuned"))))
    halve = (F.col("variant") == "finetuned") & (F.pmod("vec_id", F.lit(2)) == 0)
    return rows.select(
        F.concat(F.lit("org/model-"), F.pmod("label", F.lit(5)).cast("string"), F.lit("b")).alias("model_id"),
        "variant",
        F.concat(F.lit("layer_"), F.floor(F.col("label") / 5).cast("string")).alias("layer"),
        F.col("vec_id").alias("row_id"),
        F.when(halve, F.transform(vals, lambda v: v * 0.5)).otherwise(vals).alias("values"))


WEIGHTS_SQL = """
SELECT 'org/model-' || CAST(label % 5 AS VARCHAR) || 'b' AS model_id, v.variant,
       'layer_' || CAST(label // 5 AS VARCHAR) AS layer, vec_id AS row_id,
       CASE WHEN v.variant = 'finetuned' AND vec_id % 2 = 0
            THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.5)
            ELSE CAST(embedding AS DOUBLE[]) END AS "values"
FROM embeddings, (VALUES ('baseline'), ('finetuned')) v(variant)
"""


def generator_weights(spark: SparkSession, sf_dir: str, models: Sequence[str]) -> DataFrame:
    """``weights`` of the first models, under the names of evaluated ``models``."""
    named = F.create_map(*[F.lit(x) for k, m in enumerate(models) for x in (f"org/model-{k}b", m)])
    return weights(spark, sf_dir).withColumn("model_id", named[F.col("model_id")]).where("model_id IS NOT NULL")


def generator_spectra_sql(models: Sequence[str]) -> str:
    """Spectral changes of ``generator_weights`` from the table spectra_cmp."""
    names = " ".join(f"WHEN 'org/model-{k}b' THEN '{m}'" for k, m in enumerate(models))
    return f"(SELECT CASE model_id {names} END AS model_id, metric, baseline, finetuned, delta FROM spectra_cmp)"


# ---------------------------------------------------------------- run log
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> run records: error events are failed runs, and models 3 and 7 never succeed."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    model_id = F.concat(F.lit("org/model-"), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("b"))
    failed = (F.col("event_type") == "error") | F.pmod("user_id", F.lit(10)).isin(3, 7)
    return ev.select(
        F.col("event_id").alias("run_id"),
        model_id.alias("model_id"),
        model_short_name(model_id).alias("model_name"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("ended_at"),
        F.col("value").alias("duration_seconds"),
        F.when(failed, F.concat(F.lit("run "), F.col("event_id").cast("string"), F.lit(" failed: "),
                                F.repeat(F.col("props"), (F.pmod("event_id", F.lit(12)) + 1).cast("int"))))
        .alias("error"),
        F.concat(F.lit("cache/models/"), model_short_name(model_id), F.lit("_evaluation")).alias("output_dir"),
    )


RUNS_SQL = f"""
SELECT event_id AS run_id, mid AS model_id, {sql_model_short_name('mid')} AS model_name,
       CASE WHEN failed THEN 'failed' ELSE 'success' END AS status,
       ts AS started_at,
       ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS ended_at,
       value AS duration_seconds,
       CASE WHEN failed THEN 'run ' || CAST(event_id AS VARCHAR) || ' failed: ' ||
            repeat(props, CAST(event_id % 12 + 1 AS INTEGER)) END AS error,
       'cache/models/' || {sql_model_short_name('mid')} || '_evaluation' AS output_dir
FROM (SELECT *, 'org/model-' || CAST(user_id % 10 AS VARCHAR) || 'b' AS mid,
             event_type = 'error' OR user_id % 10 IN (3, 7) AS failed FROM events)
"""


# ---------------------------------------------------------------- named parameters
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_name", "p_brand", "p_size")
    return p.select(F.col("p_brand").alias("model_id"), F.col("p_name").alias("name"),
                    (F.col("p_size").cast("bigint") * 1000).alias("numel"),
                    (F.pmod("p_size", F.lit(5)) == 0).alias("requires_grad"))


PARAMETERS_SQL = """
SELECT p_brand AS model_id, p_name AS name, CAST(p_size AS BIGINT) * 1000 AS numel,
       (p_size % 5 = 0) AS requires_grad
FROM part
"""


# ---------------------------------------------------------------- model registry
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct model ids of the run log, 0-based ``idx`` in id order; every third id lacks a directory."""
    from ..operators.numbering import rank_global
    ids = runs(spark, sf_dir).select("model_id").distinct()
    ranked = rank_global(ids, ["model_id"], rank_col="idx", start=0)
    short = F.lower(F.regexp_replace(model_short_name(F.col("model_id")), "-", "_"))
    return ranked.select(F.col("idx").cast("int").alias("idx"), "model_id",
                         F.when(F.pmod("idx", F.lit(3)) != 2, short).alias("output_dir"))


REGISTRY_SQL = f"""
SELECT CAST(idx AS INTEGER) AS idx, model_id,
       CASE WHEN idx % 3 <> 2 THEN lower(replace({sql_model_short_name('model_id')}, '-', '_')) END AS output_dir
FROM (SELECT model_id, row_number() OVER (ORDER BY model_id) - 1 AS idx FROM (SELECT DISTINCT model_id FROM runs))
"""
