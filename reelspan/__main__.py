"""python -m reelspan phases | queries | run PHASE... --tables DIR --out DIR [--config FILE] [--skip LIST] [--include-disabled] [--execute] [--resume] | query NAME --tables DIR [--out DIR]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import phases
from .plans import QUERIES
from .sources import manifests


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reelspan", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("phases", help="list the phases")
    commands.add_parser("queries", help="list the queries")
    run = commands.add_parser("run", help="run phases, all of them if none is named; without --execute only say which would run")
    run.add_argument("phase", nargs="*", choices=[[], *phases.BY_COMMAND], default=[])
    run.add_argument("--config")
    run.add_argument("--skip", action="append", default=[])
    run.add_argument("--include-disabled", action="store_true")
    run.add_argument("--execute", action="store_true")
    run.add_argument("--resume", action="store_true", help="run only what is not there yet for these tables and settings")
    query = commands.add_parser("query", help="run one query")
    query.add_argument("name", choices=sorted(QUERIES))
    for p in (run, query):
        p.add_argument("--tables", required=True)
        p.add_argument("--out", required=p is run)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "phases":
        print(phases.phase_help())
    elif args.command == "queries":
        print("\n".join(sorted(QUERIES)))
    else:
        spark = SparkSession.builder.appName("reelspan").getOrCreate()
        if args.command == "query":
            frame = QUERIES[args.name](spark, args.tables)
            frame.write.mode("overwrite").parquet(args.out) if args.out else frame.show(truncate=False)
        else:
            config = manifests.read_config(Path(args.config).read_text()) if args.config else {}
            for command, what in phases.run(spark, args.tables, args.out, config, only=args.phase, skip=args.skip, include_disabled=args.include_disabled, execute=args.execute, resume=args.resume):
                print(f"{command:22} {what}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
