"""Command line of the jobs in ``plans.jobs``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.text import parse_positions
from .params import SketchParams
from .plans import jobs


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cohortlens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "query", "run"):
        p = commands.add_parser(name)
        p.add_argument("--sketch", required=True, help="folder of the sketch")
        if name in ("ingest", "run"):
            p.add_argument("--input", required=True, nargs="+")
            p.add_argument("--format", default="lines")
            p.add_argument("--key", default="1", help="positions of the key columns, comma-separated")
            p.add_argument("--value", default="0,3,4,5", help="value columns by position")
            p.add_argument("--mode", default="exact_counts")
            p.add_argument("--repeat", type=int, default=1)
            p.add_argument("--ingest-partitions", type=int)
            for field in ("d", "w", "levels", "k", "rows", "cols"):
                p.add_argument(f"--{field}", type=int, default=getattr(SketchParams, field))
            p.add_argument("--k-store", type=int)
        if name in ("query", "run"):
            p.add_argument("--keys", required=True)
            p.add_argument("--output", required=True)
            p.add_argument("--key-fields", type=int, default=1)
            p.add_argument("--combine", choices=("min", "median"), default="min")
            p.add_argument("--min-group-size", type=float)
            p.add_argument("--query-partitions", type=int)
            p.add_argument("--single-file", action="store_true")
            p.add_argument("--quoted", action="store_true", help="quotes protect commas in keys")
            p.add_argument("--spaced", action="store_true", help="a blank after every comma")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("cohortlens").getOrCreate()
    if args.command in ("ingest", "run"):
        params = SketchParams(
            **{f: getattr(args, f) for f in ("d", "w", "levels", "k", "rows", "cols", "k_store")}
        )
        jobs.ingest(
            spark,
            args.input,
            args.sketch,
            params,
            parse_positions(args.key),
            parse_positions(args.value),
            args.format,
            args.mode,
            args.ingest_partitions,
            args.repeat,
        )
    if args.command in ("query", "run"):
        jobs.answer_saved(
            spark,
            args.sketch,
            args.keys,
            args.output,
            key_fields=args.key_fields,
            combine=args.combine,
            min_group_size=args.min_group_size,
            min_partitions=args.query_partitions,
            single_file=args.single_file,
            quoted=args.quoted,
            spaced=args.spaced,
        )


if __name__ == "__main__":
    main()
