"""Command-line jobs: ingest, count, filter, threshold, coregister."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from sensorgrid.functions.names import rendered
from sensorgrid.functions.payload import threshold16
from sensorgrid.operators.captures import first_rows, spread, tagged_union
from sensorgrid.operators.coregister import MODES, coregister
from sensorgrid.query import add_arguments, from_arguments
from sensorgrid.session import session
from sensorgrid.sources.dispatch import open_captures, save_captures


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    captures = spread(open_captures(spark, args.input, numeric_unit=args.numeric_unit))
    save_captures(captures, args.output, args.format, args.mode)
    return open_captures(spark, args.output).count()


def count(spark: SparkSession, args: argparse.Namespace) -> int:
    captures = open_captures(spark, args.input)
    _show(captures)
    return captures.count()


def filter_captures(spark: SparkSession, args: argparse.Namespace) -> int:
    captures = open_captures(spark, args.input, from_arguments(args), not args.no_manifest)
    _show(captures)
    return captures.count()


def threshold(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes the filtered captures with their payloads thresholded."""
    captures = open_captures(spark, args.input, from_arguments(args), not args.no_manifest)
    save_captures(captures.withColumn("payload", threshold16("payload", args.threshold, not args.unsigned)), args.output, mode=args.mode)
    return spark.read.parquet(f"{args.output.rstrip('/')}/data").count()


def coregister_captures(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes (capture_id, instrument, primary_id) for the folders after the first, which is the primary."""
    query = from_arguments(args)
    base = args.input.rstrip("/")
    rows = tagged_union(open_captures(spark, f"{base}/{d}", query, not args.no_manifest).drop("payload") for d in args.folders)
    coregister(rows, args.match).write.mode(args.mode).parquet(args.output)
    return spark.read.parquet(args.output).count()


def _show(captures: DataFrame) -> None:
    for row in first_rows(captures).select(rendered().alias("text")).collect():  # ten rows
        print(row.text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sensorgrid")
    jobs = out.add_subparsers(dest="job", required=True)

    def job(name: str, run, *places: str, ranges: bool = False) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        for place in places:
            p.add_argument(place)
        if ranges:
            add_arguments(p)
            p.add_argument("--no-manifest", action="store_true", help="read all files, not only those whose zones match")
        if "output" in places:
            p.add_argument("--mode", default="errorifexists", choices=("errorifexists", "append", "overwrite"))
        p.set_defaults(run=run)
        return p

    p = job("ingest", ingest, "input", "output")
    p.add_argument("--format", default="parquet", choices=("parquet", "block", "hdf5"))
    p.add_argument("--numeric-unit", default="ms", choices=("ms", "s"))
    job("count", count, "input")
    job("filter", filter_captures, "input", ranges=True)
    p = job("threshold", threshold, "input", "output", ranges=True)
    p.add_argument("--threshold", type=int, default=0)
    p.add_argument("--unsigned", action="store_true")
    p = job("coregister", coregister_captures, "input", "output", ranges=True)
    p.add_argument("folders", nargs="+", help="folders under input; the first holds the primary instrument")
    p.add_argument("--match", default="walk", choices=MODES)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.monotonic()
    n = args.run(session(), args)
    print(f"{args.job}: {n} rows in {time.monotonic() - began:.2f} s")
    return n


