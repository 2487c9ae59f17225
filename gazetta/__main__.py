"""Command line: prep, expand, compare, jobs, datasets."""

from __future__ import annotations

import argparse
import sys

from .operators import jobs
from .plans import workflows
from .session import session
from .sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gazetta", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prep", help="write the records that need coordinates, one per place")
    p.add_argument("input"), p.add_argument("-o", "--output"), p.add_argument("--max-records", type=int)
    p.add_argument("--include-existing", action="store_true"), p.add_argument("--no-dedup", action="store_true")
    p = sub.add_parser("expand", help="put results back on every original row")
    p.add_argument("original"), p.add_argument("processed"), p.add_argument("-o", "--output")
    p.add_argument("--dwc", action="store_true"), p.add_argument("--protect-existing", action="store_true")
    p = sub.add_parser("compare", help="compare two result files by distance")
    p.add_argument("primary"), p.add_argument("secondary"), p.add_argument("output")
    p.add_argument("--formats", nargs="+", default=["csv"])
    for name, text in (("jobs", "list batch jobs in a folder"), ("datasets", "list delimited files in a folder")):
        sub.add_parser(name, help=text).add_argument("folder")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "prep":
        print(workflows.prepare(spark, a.input, a.output, a.include_existing, a.max_records, not a.no_dedup))
    elif a.command == "expand":
        print(workflows.expand(spark, a.original, a.processed, a.output, a.dwc, a.protect_existing))
    elif a.command == "compare":
        summary, written = workflows.compare(spark, a.primary, a.secondary, a.output, a.formats)
        summary.show(truncate=False)
        print("\n".join(written))
    else:
        (jobs.list_jobs if a.command == "jobs" else readers.discover_datasets)(spark, a.folder).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
