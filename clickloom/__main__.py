"""Run the pipeline from the command line: ``python -m clickloom --help``.

Under spark-submit, master, sizes and object-store settings come from its own options.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame

from clickloom.plans.pipeline import STAGES, preview, run_pipeline
from clickloom.session import create_session, input_size, size_shuffles
from clickloom.sources.events import read_events
from clickloom.sources.sinks import JdbcSink, ParquetSink, Sink


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("clickloom")
    parser.add_argument("--input", required=True, help="event log, any path Spark can read")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    target = parser.add_mutually_exclusive_group(required=True)
    target.add_argument("--output", help="folder for Parquet tables")
    target.add_argument("--jdbc-url", help="database for the tables")
    parser.add_argument("--jdbc-driver", help="class name of the database driver")
    parser.add_argument("--jdbc-user")
    parser.add_argument("--jdbc-password-from", help="environment variable with the password")
    parser.add_argument("--stage", choices=STAGES, help="default: table for csv, none for other input")
    parser.add_argument("--zone", default="UTC", help="time zone of hours and dates")
    parser.add_argument("--input-bytes", type=int, help="size of the input, to size shuffles; else from the listing")
    parser.add_argument("--resume", metavar="RUN", help="load what this failed run has stored, compute the rest")
    parser.add_argument("--preview", action="store_true", help="print the tables")
    return parser.parse_args(argv)


def _sink(args: argparse.Namespace) -> Sink:
    if args.output:
        return ParquetSink(args.output)
    given = {
        "driver": args.jdbc_driver,
        "user": args.jdbc_user,
        "password": args.jdbc_password_from and os.environ[args.jdbc_password_from],
    }
    return JdbcSink(args.jdbc_url, {name: value for name, value in given.items() if value})


def main(argv: list[str] | None = None) -> dict[str, DataFrame]:
    args = _arguments(argv)
    spark = create_session()
    size_shuffles(spark, args.input_bytes or input_size(spark, args.input))
    tables = run_pipeline(
        spark,
        read_events(spark, args.input, args.format, rejects=True),
        _sink(args),
        stage=args.stage,
        zone=args.zone,
        resume=args.resume,
    )
    if args.preview:
        preview(tables)
    return tables


if __name__ == "__main__":
    main()
