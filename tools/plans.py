"""Show what is costly in the plan of every query: exchanges, single partitions, nested loops, Python.

    python tools/plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tagloom.queries import QUERIES  # noqa: E402
from tagloom.session import build_session  # noqa: E402

MARKS = {
    "exchanges": r"Exchange (?!SinglePartition)\w*partitioning",
    "single": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "nested loops": r"BroadcastNestedLoopJoin|CartesianProduct",
    "python": r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "sort aggregates": r"SortAggregate",
}


def plan_of(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("--show", action="store_true", help="print the plans too")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "plans", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names or QUERIES:
        plan = plan_of(QUERIES[name](spark, args.sf))
        found = {mark: len(re.findall(pattern, plan)) for mark, pattern in MARKS.items()}
        print(name, {mark: n for mark, n in found.items() if n}, flush=True)
        if args.show:
            print(plan)


if __name__ == "__main__":
    main()
