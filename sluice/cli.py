"""Command line: ``python -m sluice.cli ROOT OUT``. Exit codes: 0 done, 1 failed, 2 wrong use, 3 done with failures."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sluice.functions.names import DEFAULT_TERMS, load_terms
from sluice.operators.split import CHUNK, THRESHOLD
from sluice.plans import ingest

OK, FATAL, USAGE, PARTIAL = range(4)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluice", description="Convert dumps, delimited tables and XLSX books below ROOT to CSV files below OUT.")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--personal-only", action="store_true", help="skip dumps and tables whose names carry no personal data")
    p.add_argument("--terms", metavar="FILE", help="dictionary of names, one term a line")
    p.add_argument("--threshold", type=int, default=THRESHOLD, help="split tables of more rows")
    p.add_argument("--chunk", type=int, default=CHUNK, help="rows of a part")
    return p


def main(args: list[str] | None = None) -> int:
    try:
        given = parser().parse_args(args)
    except SystemExit as e:
        return OK if not e.code else USAGE
    spark = SparkSession.builder.appName("sluice").getOrCreate()
    try:
        terms = load_terms(given.terms) if given.terms else DEFAULT_TERMS
        done = ingest.convert(spark, given.root, given.out, personal_only=given.personal_only, terms=terms, threshold=given.threshold, chunk=given.chunk)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return FATAL
    print(f"{len(done.files)} files, {done.failures} failures")
    return PARTIAL if done.failures else OK


if __name__ == "__main__":
    sys.exit(main())
