"""Command line: the pipeline's everyday runs.

    python -m cdcmart build  --data DIR [--out DIR]    # all models, in order
    python -m cdcmart query  NAME [--data DIR] [-n 20] # any registered query
    python -m cdcmart test   [--data DIR]              # the declared model tests
    python -m cdcmart reconcile [--data DIR]           # source vs Silver keys
    python -m cdcmart list                             # registered query names
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cdcmart")
    ap.add_argument("command", choices=["build", "query", "test", "reconcile", "list"])
    ap.add_argument("name", nargs="?")
    ap.add_argument("--data", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=None)
    ap.add_argument("-n", type=int, default=20)
    a = ap.parse_args(argv)

    from cdcmart.plans.registry import QUERIES

    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from cdcmart.plans import models
    from cdcmart.session import get_spark

    spark = get_spark()
    if a.command == "build":
        wh = models.run_models(spark, a.data, a.out) if a.out else models.warehouse(spark, a.data, fresh=True)
        print(wh.root)
    elif a.command == "query":
        if a.name not in QUERIES:
            print(f"unknown query {a.name!r}; see `list`", file=sys.stderr)
            return 2
        QUERIES[a.name](spark, a.data).show(a.n, truncate=False)
    elif a.command == "test":
        res = QUERIES["dq_run_checks"](spark, a.data)
        res.orderBy("model", "column", "test").show(100, truncate=False)
        failed = res.where("NOT passed").count()
        print(f"{failed} failing tests")
        return 1 if failed else 0
    elif a.command == "reconcile":
        QUERIES["reconcile_summary"](spark, a.data).show(truncate=False)
        QUERIES["reconcile_samples"](spark, a.data).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
