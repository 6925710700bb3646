"""Prints the static physical plan (operator tree, details trimmed) of catalog
queries, for plan review: where the exchanges are, what is broadcast, what
reaches the scan."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans import catalog  # noqa: E402
from quire.session import get_spark  # noqa: E402

KEEP = re.compile(r"(Exchange|Join|Window|Aggregate|MapInArrow|CoGroupsInArrow|ArrowEvalPython|Scan|Generate|Limit|"
                  r"TakeOrdered|Union|Sort \[|InMemory|Expand|BatchEvalPython|Filter)")


def compact(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\(\d+ paths\)\[file:[^\]]*/([a-z_]+)\.parquet\]", r"\1", line)
    line = re.sub(r", PartitionFilters: \[\].*", "", line)
    line = re.sub(r"\[plan_id=\d+\]", "", line)
    return line[:170]


def main():
    root = sys.argv[1]
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # static plan (AQE re-plans at run time)
    for name in names:
        plan = catalog.QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
        print(f"### {name}\n```")
        for line in plan.split("\n"):
            if KEEP.search(line):
                print(compact(line.rstrip()))
        print("```\n")


if __name__ == "__main__":
    main()
