"""Physical-plan shape of every registered query: writes PLANS.md.

For each query: shuffle exchanges (and which are REPARTITION / SinglePartition),
broadcasts, join strategies, Python stages, aggregates, windows, and the
filters pushed into parquet scans.  Plans are the initial adaptive plans
(AQE may still coalesce partitions or turn a sort-merge join into a broadcast
at run time).  Queries that materialise intermediates run those writes while
the plan is built.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tripleval.plans.registry import oracle_sql, queries  # noqa: E402
from tripleval.session import local_session  # noqa: E402


def shape(plan: str) -> dict:
    lines = plan.splitlines()
    ex = [l for l in lines if "Exchange " in l and "BroadcastExchange" not in l and "ReusedExchange" not in l]
    return {
        "shuffles": len(ex),
        "single": sum("SinglePartition" in l for l in ex),
        "repart": sum("REPARTITION" in l for l in ex),
        "bcast": sum("BroadcastExchange" in l for l in lines),
        "bhj": sum("BroadcastHashJoin" in l for l in lines),
        "smj": sum("SortMergeJoin" in l for l in lines),
        "bnlj": sum("BroadcastNestedLoopJoin" in l or "CartesianProduct" in l for l in lines),
        "python": sum(bool(re.search(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonUDF", l))
                      for l in lines),
        "window": sum("Window " in l or l.strip().startswith("+- Window") for l in lines),
        "pushed": sorted({m for l in lines for m in re.findall(r"PushedFilters: \[([^\]]+)\]", l)}),
    }


def node_tree(node, depth: int = 0) -> list[str]:
    """Operator tree from the JVM plan nodes: names, exchange partitioning, scanned folders."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return [("  " * depth) + name] + node_tree(node.executedPlan(), depth + 1)
    label = name
    if "Exchange" in name and name != "BroadcastExchange":
        label += " " + re.sub(r"#\d+L?", "", node.outputPartitioning().toString())
    if name.startswith("Scan") or "FileScan" in name or name == "Scan parquet":
        m = re.search(r"Location: \w+\[([^\]]*)\]", node.simpleString(5))
        if m:
            label += " " + m.group(1).rstrip("/").rsplit("/", 1)[-1][:40]
    lines = [("  " * depth) + label]
    children = node.children()
    for i in range(children.size()):
        lines += node_tree(children.apply(i), depth + 1)
    return lines


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    qs, sq = queries(), oracle_sql()
    rows = []
    flagship_tree = ""
    for k, fn in qs.items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((k, shape(plan)))
        if k == "evaluate_models":
            flagship_tree = "\n".join(node_tree(df._jdf.queryExecution().executedPlan()))
    out = ["# Physical plan shapes", "",
           f"Generated by `tools/plan_report.py` at `{sf}` with `spark.sql.shuffle.partitions=8`.",
           "Counts are over the initial adaptive plan of each registered query (AQE may coalesce",
           "partitions or broadcast a small join side at run time). `single` = exchanges to one",
           "partition; every one of them moves a table whose size is bounded (bucket-size and",
           "partition-size tables of global numbering, one-row totals, top-k) - see README.",
           "Materialised intermediates (written tables, checkpoints) appear as scans.", "",
           "| query | oracle | shuffles | single | repartition | broadcast | BHJ | SMJ | nested-loop | "
           "python | window | pushed filters |",
           "|---|---|---|---|---|---|---|---|---|---|---|---|"]
    for k, s in rows:
        out.append(f"| `{k}` | {'SQL' if k in sq else 'rows'} | {s['shuffles']} | {s['single']} | {s['repart']} | "
                   f"{s['bcast']} | {s['bhj']} | {s['smj']} | {s['bnlj']} | {s['python']} | {s['window']} | "
                   f"{'; '.join(s['pushed'])[:120]} |")
    out += ["", "## Flagship (`evaluate_models`) physical plan", "",
            "Operator tree of the initial adaptive plan. Inputs are the materialised examples and",
            "index-token tables in the shared folder (folder names end in a random suffix).", "",
            "```", flagship_tree, "```"]
    open(__file__.rsplit("/tools/", 1)[0] + "/PLANS.md", "w").write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
