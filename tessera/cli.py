"""Command line: ``python -m tessera.cli COMMAND``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .operators.intervals import IntervalFrame
from .sources.parquet import CODECS, ParquetOptions

LOG = logging.getLogger("tessera")


def _overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    frame = IntervalFrame(spark.read.parquet(a.input), a.start_column, a.end_column, a.plane_column)
    ParquetOptions(a.block_size, a.page_size, a.compression, not a.no_dictionary).write(frame.overlapping(a.start, a.end, a.plane).df, a.output)


def _z_score(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.statistics import z_score

    ParquetOptions(a.block_size, a.page_size, a.compression, not a.no_dictionary).write(z_score(spark.read.parquet(a.input), a.column), a.output)


def _overlap_arguments(c: argparse.ArgumentParser) -> None:
    c.add_argument("start", type=int)
    c.add_argument("end", type=int)
    c.add_argument("--start-column", default="start")
    c.add_argument("--end-column", default="end")
    c.add_argument("--plane-column")
    c.add_argument("--plane")


@dataclass(frozen=True)
class Command:
    """What a command says of itself, what it does with a session and its arguments, and the arguments of its own."""

    name: str
    help: str
    run: Callable[[SparkSession, argparse.Namespace], None]
    arguments: Callable[[argparse.ArgumentParser], None] = lambda c: None


COMMANDS: dict[str, Command] = {}


def register(command: Command) -> Command:
    """Adds a command, or replaces that of its name."""
    COMMANDS[command.name] = command
    return command


register(Command("overlap", "Write the rows that overlap an interval.", _overlap, _overlap_arguments))
register(Command("zscore", "Write the rows with a column's z-score.", _z_score, lambda c: c.add_argument("column")))


def parser() -> argparse.ArgumentParser:
    """The registered commands, each with input, output, Parquet options, and a log file."""
    p = argparse.ArgumentParser(prog="tessera", description="Interval, similarity and mixture analytics.")
    commands = p.add_subparsers(dest="command", required=True)
    for own in COMMANDS.values():
        c = commands.add_parser(own.name, help=own.help, description=own.help)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--block-size", type=int, default=128 << 20)
        c.add_argument("--page-size", type=int, default=1 << 20)
        c.add_argument("--compression", choices=CODECS, default="gzip")
        c.add_argument("--no-dictionary", action="store_true")
        c.add_argument("--log-file", help="what is logged from INFO on; warnings go to stderr too")
        c.set_defaults(run=own.run)
        own.arguments(c)
    return p


def _logging(path: str | None) -> logging.Handler | None:
    """Warnings to stderr, and from INFO on to a file if one is named."""
    logging.basicConfig(level=logging.WARNING)
    if not path:
        return None
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    return handler


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 for an error, 2 for wrong arguments. A session made here is stopped here."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    handler = _logging(a.log_file)
    own = spark is None
    if own:
        builder = SparkSession.builder.appName(a.command)
        if not os.environ.get("MASTER") and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
            builder = builder.master("local[*]")
        spark = builder.getOrCreate()
    try:
        LOG.info("%s of %s to %s", a.command, a.input, a.output)
        a.run(spark, a)
        LOG.info("%s done", a.command)
        return 0
    except Exception:
        LOG.exception("%s failed", a.command)
        return 1
    finally:
        if handler:
            LOG.removeHandler(handler)
            handler.close()
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
