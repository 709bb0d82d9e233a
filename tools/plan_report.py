"""Physical-plan facts of the headline queries on the materialized panel.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
For each query: shuffles, sorts, window operators, broadcast and sort-merge
joins, and every Parquet scan with its partition filters and read columns
(from the final adaptive plan after one execution).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from riskflow.plans import queries as Q  # noqa: E402
from riskflow.session import get_session  # noqa: E402


def facts(df) -> dict:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    scans = []
    for line in final.split("\n"):
        if "FileScan parquet" not in line and "Scan parquet" not in line:
            continue
        loc = re.search(r"Location: \w+\([^)]*\)\[([^\],]*)", line)
        pf = re.search(r"PartitionFilters: \[([^\]]*)\]", line)
        rs = re.search(r"ReadSchema: struct<(.*)>", line)
        cols = re.findall(r"(\w+):", rs.group(1)) if rs else []
        scans.append((os.path.basename((loc.group(1) if loc else "?").rstrip("/]")),
                      (pf.group(1) if pf else "")[:70], cols))
    return {"shuffles": final.count("Exchange hashpartitioning") + final.count("Exchange rangepartitioning"),
            "single": final.count("Exchange SinglePartition"),
            "sorts": final.count("Sort ["), "windows": final.count("Window ["),
            "bhj": final.count("BroadcastHashJoin"), "smj": final.count("SortMergeJoin"),
            "scans": scans}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(extra={"spark.sql.maxMetadataStringLength": "100000"})
    base = Q.pf(spark, sf)
    mat = base.materialize()
    print("# Plan report\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}`. Stage 1 (the featured panel build):\n")
    f = facts(base.featured)
    print(f"* featured panel: shuffles={f['shuffles']} sorts={f['sorts']} windows={f['windows']} "
          f"broadcast joins={f['bhj']} sort-merge joins={f['smj']}")
    for s in f["scans"]:
        print(f"  * scan `{s[0]}` columns={len(s[2])} ({', '.join(s[2])})")
    Q._PORTFOLIOS[(id(spark), sf)] = mat
    print("\nHeadline queries on the materialized, month-partitioned table "
          "(`featured` = the stored panel, `P` = the stored one-row matrix):\n")
    print("| query | shuffles | single-partition | sorts | windows | BHJ | SMJ | scans (table: columns read; partition filter) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in HEADLINE:
        f = facts(Q.QUERIES[name](spark, sf))
        sc = "; ".join(f"{s[0]}: {len(s[2])} cols" + (f", `{s[1]}`" if s[1] else "") for s in f["scans"])
        print(f"| {name} | {f['shuffles']} | {f['single']} | {f['sorts']} | {f['windows']} | {f['bhj']} | "
              f"{f['smj']} | {sc} |")
    spark.stop()


if __name__ == "__main__":
    main()
