"""Write PLANS.md: what every catalogue query executes.

Usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.1)

Each query runs once as it is and once with broadcast joins by size off
(``autoBroadcastJoinThreshold=-1``), the shape at a scale where no side is small. The
final adaptive plans of all executions of a query, also of the jobs that run while the query is
built (checkpoints, model fits, CSV files), come from Spark's event log in a scratch folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COLUMNS = {"executions": None, "scans": r"Scan parquet|Scan csv", "shuffles": r"Exchange$", "reused": r"ReusedExchange", "broadcasts": r"BroadcastExchange",
           "SMJ": r"SortMergeJoin", "BHJ": r"BroadcastHashJoin", "one-row": r"BroadcastNestedLoopJoin|CartesianProduct",
           "aggregates": r"(Hash|ObjectHash|Sort)Aggregate", "windows": r"Window$", "python": r"Pandas|Arrow|Python", "generate": r"Generate$"}


def _nodes(plan: dict, names: list[str]) -> list[str]:
    names.append(plan["nodeName"].split(" (")[0].strip())
    if not plan["nodeName"].startswith("ReusedExchange"):
        for child in plan["children"]:
            _nodes(child, names)
    return names


def run(sf_dir: str, conf: dict) -> dict[str, Counter]:
    from matingstats import get_spark
    from matingstats.plans.catalog import queries

    log = tempfile.mkdtemp(prefix="plan-events-")
    spark = get_spark("local[8]", shuffle_partitions=16, checkpoint_dir=tempfile.mkdtemp(prefix="plan-ckpt-"),
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.rolling.enabled": "false",
                             "spark.eventLog.compress": "false", "spark.ui.showConsoleProgress": "false", **conf})
    ends = []
    for name, query in queries().items():
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        ends.append((time.time() * 1000, name))
    spark.stop()
    plans, began = {}, {}
    (path,) = [os.path.join(log, f) for f in os.listdir(log)]
    with open(path) as f:
        for line in f:
            if '"sparkPlanInfo"' in line:
                e = json.loads(line)
                plans[e["executionId"]] = _nodes(e["sparkPlanInfo"], [])
                began.setdefault(e["executionId"], e.get("time", 0))
    out = {name: Counter() for _, name in ends}
    for k, names in plans.items():
        name = next(n for end, n in ends if began[k] <= end)
        out[name]["executions"] += 1
        for column, pattern in COLUMNS.items():
            if pattern:
                out[name][column] += sum(bool(re.search(pattern, n)) and (column != "shuffles" or n in ("Exchange", "ShuffleExchange")) for n in names)
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    lines = ["# PLANS - what every query executes", "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}` (local[8], AQE on, 16 shuffle partitions).",
             "Counts are operators in the final adaptive plans of all executions of a query: the jobs that run while it is",
             "built (checkpoints, model fits, CSV files) and the query itself. `reused` are exchanges AQE served from an",
             "earlier stage. `one-row` are nested-loop joins with a one-row total (or a one-row table of draws)."]
    for title, conf in (("As it is", {}), ("With broadcasts by size off", {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})):
        lines += ["", f"## {title}", "", "| query | " + " | ".join(COLUMNS) + " |", "| --- |" + " --- |" * len(COLUMNS)]
        lines += [f"| {name} | " + " | ".join(str(c[k]) for k in COLUMNS) + " |" for name, c in run(sf_dir, conf).items()]
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main()
