"""Command line: the evaluation, fleet, explorer and output-folder workflows as Spark jobs.

    python -m tripleval evaluate --triplets T.jsonl --facts test=a.csv,train=b.csv,val=c.csv --out OUT
    python -m tripleval fleet    --triplets ... --facts ... --models m1,m2 --select 0-3 --out OUT
    python -m tripleval explore  --triplets T.jsonl stats|distribution|lengths|forms|page|filter|export ...
    python -m tripleval output-dirs --models m1,m2 --dirs m1=dir1

Inputs are read with explicit schemas (``sources.files``); results are
written by the distributed sinks; only bounded results (metric tables, one
page, the first N rows) are shown on the console.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, explore, runs
from .operators.generate import MAX_NEW_WORDS, NATIVE_GENERATORS
from .operators.spectral import filter_has_spectra
from .operators.split import assemble_datasets, seeded_split
from .operators.triplets import facts_to_triplets, render_prompt
from .plans import evaluate as ev
from .plans.fleet import run_fleet
from .session import ship_package, write_table
from .sinks import writers
from .sources import files
from .streaming.run_summary import metrics_map


def _session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("tripleval")
    if master:
        b = b.master(master)
    return b.config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _show(df: DataFrame) -> None:
    """Print all rows, a partition at a time: tables of one row per model, metric or form."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join(str(v) for v in row))


def _facts_paths(spec: str) -> dict[str, str]:
    out = {}
    for part in spec.split(","):
        k, _, v = part.partition("=")
        out[k.strip()] = v.strip()
    return out


def _read_triplets(spark: SparkSession, a) -> DataFrame:
    records, bad = files.sound_records(files.src_triplets_json(spark, a.triplets, multi_line=a.multi_line))
    if bad:
        print(f"warning: {bad} malformed lines or files in {a.triplets} were left out", file=sys.stderr)
    return records


def _examples(spark: SparkSession, a) -> DataFrame:
    trip = _read_triplets(spark, a)
    ident = render_prompt(seeded_split(trip, "triplet_id", a.seed, a.val_fraction))
    if a.facts:
        fmt = "csv" if a.facts_format == "csv" else a.facts_format
        opts = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
                "ignoreTrailingWhiteSpace": False} if fmt == "csv" else {}
        facts = files.src_fact_files(spark, _facts_paths(a.facts), fmt, **opts).withColumn(
            "fact_id", F.col("fact_id").cast("bigint"))
        ex = assemble_datasets(ident, render_prompt(facts_to_triplets(facts)))
    else:
        ex = ident
    return write_table(ex.drop("text"), "examples", ["split"])


def _generators(specs: list[str]) -> dict:
    """``model=module:factory`` options as model id -> factory."""
    out = {}
    for spec in specs:
        model, _, place = spec.partition("=")
        module, _, name = place.partition(":")
        out[model] = getattr(importlib.import_module(module), name)
    return out


def cmd_evaluate(spark: SparkSession, a) -> None:
    generators = _generators(a.generator)
    models = a.models.split(",") if a.models else [*NATIVE_GENERATORS, *generators]
    weights = spark.read.parquet(a.weights) if a.weights else None
    e = ev.evaluate_models(_examples(spark, a), models, skip_finetuning=a.skip_finetuning, generators=generators, weights=weights,
                           max_new_words=a.max_new_words)
    spectra = None if e.spectra is None else write_table(e.spectra, "spectra")
    writers.sink_predictions_jsonl(e.predictions, f"{a.out}/predictions")
    writers.sink_metrics_summary(e.comparison, f"{a.out}/metrics", spectra)
    if spectra is not None:
        _show(spectra.orderBy("model_id", "metric"))
    _show(e.comparison.orderBy("model_id", "distribution", "metric"))


def cmd_fleet(spark: SparkSession, a) -> None:
    generators = _generators(a.generator)
    model_list = a.models.split(",") if a.models else [*NATIVE_GENERATORS, *generators]
    registry = files.src_model_registry(spark, model_list, _facts_paths(a.dirs) if a.dirs else {})
    chosen = runs.select_by_index(registry, a.select, len(model_list))
    selected = [m for m in model_list if m in {r.model_id for r in chosen.select("model_id").collect()}]
    ex = _examples(spark, a)
    run_log, metrics = run_fleet(spark, ex, selected, path=f"{a.out}/fleet", resume=a.resume, generators=generators,
                                 max_new_words=a.max_new_words)
    run_log = runs.resolve_output_dir(run_log, registry, a.base or f"{a.out}/models").withColumnRenamed("resolved_dir", "output_dir")
    run_log, metrics = write_table(run_log, "fleet-runs"), write_table(metrics, "fleet-metrics")
    comparison = compare.compare_variants(metrics)
    done = spark.read.parquet(f"{a.out}/fleet/predictions") if run_log.where("status = 'success'").head(1) else None
    for r in run_log.where("status = 'success'").select("model_id", "output_dir").collect():     # as long as the fleet's list
        writers.sink_predictions_jsonl(done.where(F.col("model_id") == r["model_id"]), f"{r['output_dir']}/predictions")
    spectra = write_table(ev.spectral_changes(spark.read.parquet(a.weights), selected), "spectra") if a.weights else None
    writers.sink_fleet_summary(run_log, comparison, f"{a.out}/summary", spectra)
    # result lines carry each model's metrics map; stream_improvement_table can follow them
    writers.sink_batch_summary(run_log.join(metrics_map(comparison), "model_id", "left"), f"{a.out}/batch_summary")
    writers.sink_metrics_summary(comparison, f"{a.out}/metrics", spectra)
    if spectra is not None:
        filter_has_spectra(run_log, spectra).select("model_id", "status", "alpha_weighted_delta").show(truncate=False)
    runs.run_status_counts(run_log).show()
    compare.improvement_table(comparison).show(truncate=False)
    compare.leaderboard(comparison).show(truncate=False)


def cmd_explore(spark: SparkSession, a) -> None:
    trip = _read_triplets(spark, a)
    if a.what == "stats":
        explore.dataset_stats(trip).show(truncate=False)
    elif a.what == "distribution":
        _show(explore.form_distribution(trip))
    elif a.what == "lengths":
        explore.length_table(trip).show()
    elif a.what == "forms":
        _show(explore.sorted_forms(trip).orderBy("position"))
    elif a.what == "page":
        page = explore.page_slice(trip, a.page, a.size)
        page.orderBy("item").show(a.size, truncate=False, vertical=True)
    elif a.what == "filter":
        explore.first_n(explore.filter_by_form(trip, a.form), ["triplet_id"], a.n).show(
            a.n, truncate=False, vertical=True)
    elif a.what == "export":
        form = None if a.form in (None, "All") else a.form
        if a.format == "json":
            writers.export_json(trip, form, a.out)
        elif a.format == "csv":
            writers.export_csv(trip, form, a.out)
        else:
            writers.export_markdown(trip, form, a.out)


def cmd_output_dirs(spark: SparkSession, a) -> None:
    ids = a.models.split(",")
    dirs = _facts_paths(a.dirs) if a.dirs else {}
    reg = files.src_model_registry(spark, ids, dirs)
    runs.resolve_output_dir(reg.select("idx", "model_id"), reg, a.base).orderBy("idx").show(truncate=False)
    runs.missing_output_dirs(reg, reg).show(truncate=False)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tripleval")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)

    def data_args(sp):
        sp.add_argument("--triplets", required=True, help="triplet records (JSON lines, or --multi-line arrays)")
        sp.add_argument("--multi-line", action="store_true")
        sp.add_argument("--facts", default=None, help="split=path,...  (test, train, val in that order)")
        sp.add_argument("--facts-format", default="csv", choices=["csv", "parquet", "json"])
        sp.add_argument("--seed", type=int, default=ev.SEED)
        sp.add_argument("--val-fraction", type=float, default=ev.VAL_FRACTION)
        sp.add_argument("--out", required=True)

    e = sub.add_parser("evaluate")
    data_args(e)
    e.add_argument("--models", default=None)
    e.add_argument("--skip-finetuning", action="store_true")
    f = sub.add_parser("fleet")
    data_args(f)
    f.add_argument("--models", default=None)
    f.add_argument("--select", default="all")
    f.add_argument("--resume", action="store_true", help="run only models without a successful record under --out")
    f.add_argument("--dirs", default=None, help="model=dir,...: output folders under --base")
    f.add_argument("--base", default=None, help="where models have their output folders (default: models under --out)")
    for sp in (e, f):
        sp.add_argument("--max-new-words", type=int, default=MAX_NEW_WORDS, help="limit of a generated answer")
        sp.add_argument("--weights", default=None, help="parquet of weight rows (model_id, variant, layer, values): adds spectral changes")
        sp.add_argument("--generator", action="append", default=[], metavar="MODEL=MODULE:FACTORY",
                        help="a model of one's own: a factory as in operators.generate.generate_with")
    x = sub.add_parser("explore")
    x.add_argument("--triplets", required=True)
    x.add_argument("--multi-line", action="store_true")
    x.add_argument("what", choices=["stats", "distribution", "lengths", "forms", "page", "filter", "export"])
    x.add_argument("--page", type=int, default=1)
    x.add_argument("--size", type=int, default=10, choices=list(explore.PAGE_SIZES))
    x.add_argument("--form", default=None)
    x.add_argument("--n", type=int, default=10)
    x.add_argument("--format", default="json", choices=["json", "csv", "md"])
    x.add_argument("--out", default=None)
    o = sub.add_parser("output-dirs")
    o.add_argument("--models", required=True)
    o.add_argument("--dirs", default=None, help="model=dir,...")
    o.add_argument("--base", default="cache/models")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = spark or _session(a.master)
    ship_package(spark)
    {"evaluate": cmd_evaluate, "fleet": cmd_fleet, "explore": cmd_explore,
     "output-dirs": cmd_output_dirs}[a.cmd](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
