"""Physical-plan summary of registered queries (operators, scans, joins).

    python tools/show_plans.py [sf_dir] [query-id-substring ...]

For each query: the count of each physical operator of interest after AQE
(joins by strategy, aggregates, exchanges, top-k, windows) and the pruned
scan schemas, so plan regressions (a sort-merge join on a lookup, a
nested-loop join, a Python UDF, an unpruned scan) are visible at a glance.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, ".")

from ridepulse.plans.catalog import REGISTRY  # noqa: E402
from ridepulse.session import local_session  # noqa: E402

OPS = (r"(HashAggregate|SortAggregate|ObjectHashAggregate|BroadcastHashJoin \w+|SortMergeJoin \w+|"
       r"ShuffledHashJoin \w+|BroadcastNestedLoopJoin|CartesianProduct|TakeOrderedAndProject|"
       r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning|"
       r"BroadcastExchange|Window|FileScan parquet|BatchEvalPython|ArrowEvalPython)")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = local_session(8)
    for name, (fn, _) in REGISTRY.items():
        if pats and not any(p in name for p in pats):
            continue
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()  # final (adaptive) plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = dict(Counter(re.findall(OPS, plan)))
        scans = re.findall(r"ReadSchema: (struct<[^\n]*?>)(?=\s|$)", plan)
        print(f"{name}: {ops}")
        for s in scans:
            print(f"    scan {s}")


if __name__ == "__main__":
    main()
