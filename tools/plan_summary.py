"""Summarise the physical plan of every query of the catalog (shuffles, joins,
Python stages, scan pruning) into docs/PLANS.md. The training-data queries are
left out: they run jobs while they are planned, and read written tables.

    python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from notewise.plans import catalog  # noqa: E402
from notewise.session import local_session  # noqa: E402


def summarise(plan: str) -> dict:
    lines = plan.split("\n")
    return {
        "shuffles": sum(1 for l in lines if re.search(r"[+-] Exchange (?!.*Broadcast)", l)),
        "broadcasts": sum(1 for l in lines if "BroadcastExchange" in l),
        "joins": sorted({m.group(1) for l in lines for m in [re.search(r"(\w+Join)\b", l)] if m}),
        "python": sorted({m.group(1) for l in lines for m in [re.search(r"(ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython)", l)] if m}),
        "windows": sum(1 for l in lines if re.search(r"[+-] Window \[", l)),
        "group_limit": any("WindowGroupLimit" in l for l in lines),
        "scans": [re.sub(r"#\d+L?", "", re.sub(r".*FileScan (\w+) \[([^\]]*)\].*", r"\1(\2)", l)).strip()
                  for l in lines if "FileScan" in l],
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `tools/plan_summary.py` on `{sf}` (plan before AQE re-planning; "
           "`shuffles` counts Exchange nodes, `broadcasts` BroadcastExchange nodes).", "",
           "| query | shuffles | broadcasts | joins | python stages | windows | scans (columns read) |",
           "| --- | --- | --- | --- | --- | --- | --- |"]
    for name, q in catalog.QUERIES.items():
        df = q(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        win = f"{s['windows']}" + (" (group limit)" if s["group_limit"] else "")
        scans = "; ".join(sorted(set(s["scans"])))
        out.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {', '.join(s['joins']) or '-'} | "
                   f"{', '.join(s['python']) or '-'} | {win} | {scans} |")
        print(name, s["shuffles"], flush=True)
    root = __file__.rsplit("/tools/", 1)[0]
    with open(root + "/docs/PLANS.md", "w") as f:
        f.write("\n".join(out) + "\n")
    # the flagship query's full formatted plan
    from notewise.plans.flagship import step_rouge_l
    flag = step_rouge_l(spark, sf)
    text = flag._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with open(root + "/docs/FLAGSHIP_PLAN.txt", "w") as f:
        f.write(re.sub(r"file:/\S+/testdata/", "testdata/", text))


if __name__ == "__main__":
    main()
