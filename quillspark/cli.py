"""Command line: converts folders of documents to Markdown with a report.

    python -m quillspark.cli IN... --out DIR [--report DIR] [--overwrite] [--no-recursive] [--skip-scanned] [--list]
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.sources import documents, readers

#: Files that --list shows.
PREVIEW = 10


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__.splitlines()[0])
    p.add_argument("inputs", nargs="*", help="folders or files")
    p.add_argument("--out", default="output_md", help="folder of the Markdown files")
    p.add_argument("--report", help="folder of the reports (default: OUT_report)")
    p.add_argument("--overwrite", action="store_true", help="convert again what is there")
    p.add_argument("--no-recursive", dest="recursive", action="store_false", help="leave out folders below")
    p.add_argument("--skip-scanned", action="store_true", help="leave out images and scans")
    p.add_argument("--list", action="store_true", help=f"show how many files there are and the first {PREVIEW}")
    p.add_argument("--formats", action="store_true", help="show which formats can be read")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = options().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    if a.formats:
        for r in readers.availability(spark).orderBy("suffix").collect():
            print(f".{r.suffix}: {'yes' if r.readable else r.reason}")
        return 0
    report = a.report or f"{a.out.rstrip('/')}_report"
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # the only clock: of the command, not of an operator
    for path in a.inputs:
        if a.list:
            files = readers.listing(spark, path, a.recursive)
            print(f"{files.count()} files")
            for r in files.limit(PREVIEW).collect():
                print(f"  {r.path}")
            continue
        done = documents.convert_batch(spark, path, a.out, report, now, a.overwrite, a.recursive, a.skip_scanned)
        print(", ".join(f"{s}: {n}" for s, n in done.groupBy("status").agg(F.count("*")).orderBy("status").collect()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
