"""Command lines: ``python -m geodrift.plans.cli compare …`` and ``… grid …``."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from geodrift.plans.comparison import compare, grid_to_geoparquet
from geodrift.sources import fetch
from geodrift.sources.sinks import default_grid_name

#: Fixed: directives of date formats with the Spark pattern and the digits they stand for.
DIRECTIVES = {"%Y": ("yyyy", r"\d{4}"), "%m": ("MM", r"\d{2}"), "%d": ("dd", r"\d{2}"), "%y": ("yy", r"\d{2}"), "%j": ("DDD", r"\d{3}"), "%H": ("HH", r"\d{2}"), "%M": ("mm", r"\d{2}"), "%S": ("ss", r"\d{2}")}


def date_format(form: str) -> tuple[str, str]:
    """(regular expression with one group, Spark pattern) of a format such as %Y%m%d."""
    pattern, spark_form = form, form
    for directive, (name, digits) in DIRECTIVES.items():
        pattern, spark_form = pattern.replace(directive, digits), spark_form.replace(directive, name)
    return f"({pattern})", spark_form


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geodrift")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compare", help="GPS against InSAR")
    c.add_argument("--timeseries-files", nargs="+", required=True)
    c.add_argument("--los-enu-file", required=True)
    c.add_argument("--catalogue", help="downloaded to the cache if not given")
    c.add_argument("--series", nargs="+", help="downloaded to the cache if not given")
    c.add_argument("--cache")
    c.add_argument("--output-dir", default="GPS")
    c.add_argument("--file-date-fmt", default="%Y%m%d")
    for name in ("--reference-station", "--temporal-coherence-file", "--similarity-file"):
        c.add_argument(name)
    g = commands.add_parser("grid", help="download and convert gridded series")
    g.add_argument("data_dir", type=Path)
    g.add_argument("--geoparquet-path")
    g.add_argument("--max-workers", type=int, default=8)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, fetcher: fetch.Fetcher = fetch.http) -> None:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("geodrift").getOrCreate()
    if given.command == "compare":
        pattern, form = date_format(given.file_date_fmt)
        options = {k: v for k, v in vars(given).items() if k not in ("command", "file_date_fmt")}
        compare(spark, **options, fetcher=fetcher, date_pattern=pattern, date_format=form)
        return
    lookup = fetch.download_lookup(given.data_dir, fetcher)
    fetch.download_grid(given.data_dir, workers=given.max_workers, fetcher=fetcher)
    output = given.geoparquet_path or str(given.data_dir / default_grid_name(datetime.now(timezone.utc).date()))
    grid_to_geoparquet(spark, lookup=str(lookup), series=f"{given.data_dir}/*_IGS14.tenv8", output=output)


if __name__ == "__main__":
    main()
