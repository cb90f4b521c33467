"""Command line: ``python -m foliospark.cli parse|markdown|check INPUT OUTPUT``; exit 0 done, 1 a check found something, 2 wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .config import CHOICES, RunConfig
from .operators import audit
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("command", choices=("parse", "markdown", "check"))
    p.add_argument("input", help="folder of PDF files, in any store that Spark reads")
    p.add_argument("output", nargs="?", help="folder for the tables; not for check")
    p.add_argument("--page-furniture", choices=CHOICES["page_furniture"], default="drop")
    p.add_argument("--replace", action="store_true", help="replace an output that exists")
    return p


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    if options.command != "check" and not options.output:
        print("an output folder is needed", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    tables = api.parse_pdf(spark, options.input, RunConfig(page_furniture=options.page_furniture))
    if options.command == "check":
        found = api.check(tables, tables["objects"], tables["pages"]).limit(20).collect()
        for r in found:
            print(r.doc_id, r.check, r.subject, r.detail)
        return int(bool(found))
    try:
        sinks.publish(spark, {"markdown": api.to_markdown(tables)} if options.command == "markdown" else tables, options.output, options.replace)
    except (FileExistsError, audit.InvariantError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
