"""python -m textloom list | run NAME --tables DIR [--out DIR] [--format parquet|json|csv] [--fail-on-rows]

Exit codes: 0 done; 1 rows were found and --fail-on-rows is given; 2 wrong arguments; 3 a table can't be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from textloom.plans.catalogue import QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    parts = parser.add_subparsers(dest="what", required=True)
    parts.add_parser("list", help="names of all queries")
    run = parts.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES), metavar="NAME")
    run.add_argument("--tables", required=True)
    run.add_argument("--out")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    run.add_argument("--fail-on-rows", action="store_true")
    given = parser.parse_args(args)
    if given.what == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    try:
        found = QUERIES[given.name](spark, given.tables)
    except AnalysisException as e:
        print(e, file=sys.stderr)
        return 3
    if given.out:
        found.write.mode("overwrite").format(given.format).save(given.out)
    else:
        found.show(50, truncate=60)
    return int(given.fail_on_rows and not found.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
