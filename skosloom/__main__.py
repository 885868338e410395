"""Command line: ``python -m skosloom --input FILE --output FOLDER``."""

from __future__ import annotations

import argparse
import datetime
import logging

from pyspark.sql import SparkSession

from skosloom.plans import pipeline
from skosloom.sources import tsv


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="skosloom", description="Concept file to hierarchy")
    p.add_argument("--input", required=True, help="tab-separated concept file")
    p.add_argument("--output", required=True, help="folder for the results")
    p.add_argument("--no-discovery", action="store_true", help="leave out links by context")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> dict[str, str]:
    args = arguments(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("skosloom").getOrCreate()
    result = pipeline.run(tsv.read_concepts(spark, args.input), discover=not args.no_discovery)
    out = pipeline.write_all(result, args.output, datetime.date.today().isoformat())
    for name in ("html", "json"):
        spark.createDataFrame([(out[name],)], "text string").coalesce(1).write.mode("overwrite").text(f"{args.output}/report.{name}")
    logging.getLogger("skosloom").info("%s", result.stats)
    return out


if __name__ == "__main__":
    main()
