"""Bench: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
result transfer to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripleval.plans.registry import queries  # noqa: E402
from tripleval.session import local_session  # noqa: E402

HEADLINE = [
    "evaluate_models",       # flagship: whole pipeline, all models, both variants, all metrics
    "seeded_split",
    "fit_answerer",
    "rouge1",
    "rougeL",
    "bleu",
    "rougeLsum",
    "dataset_stats",
    "form_distribution",
    "page_slice",
    "build_vocab",
    "pad_batches",
    "spectral_layer_stats",
    "run_status_counts",
    "rouge_bootstrap",
    "stream_run_summary",
]

# A trivial query of the same run: times relative to it can be compared across machines and days.
CONTROL = "run_status_counts"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    qs = queries()
    names = [q for q in HEADLINE if q in qs]
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    # warm-up on the smallest scale (same code paths, nothing of sf_dir cached):
    # JVM class loading, code generation and the Python worker pool
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    qs["evaluate_models"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not lose the others' timings
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(sum(t for t in times.values() if t is not None), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
           "cpus": cpus}
    if times.get(CONTROL):
        out["relative_to_control"] = {n: round(t / times[CONTROL], 1) for n, t in times.items() if t is not None}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
