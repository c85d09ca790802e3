"""Command line: list operators and queries, run a query over a folder of tables, or ingest documents.

    python -m larkspur operators [--category text]
    python -m larkspur query corpus_by_lang --tables DIR [--out DIR]
    python -m larkspur ingest DIR [--extensions txt,docx] [--out DIR]
"""

from __future__ import annotations

import argparse

from . import queries
from .registry import registry
from .session import get_session
from .sources import ingest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur", description="Document, web, file and telemetry analytics on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    ops = commands.add_parser("operators", help="names and purposes of operators")
    ops.add_argument("--category")
    run = commands.add_parser("query", help="run a registered query")
    run.add_argument("name", choices=sorted(queries.QUERIES), metavar="name")
    run.add_argument("--tables", required=True, help="folder of Parquet tables")
    load = commands.add_parser("ingest", help="clean chunks of documents")
    load.add_argument("path")
    load.add_argument("--extensions", type=lambda s: s.split(","))
    for p in (run, load):
        p.add_argument("--out", help="folder for the result as Parquet; without it, the first rows are shown")
        p.add_argument("--rows", type=int, default=20, help="rows that are shown")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session()
    if args.command == "operators":
        known = registry.describe(spark)
        known.where(known.category == args.category if args.category else "true").orderBy("category", "name").show(1000, truncate=False)
        return
    if args.command == "query":
        result = queries.QUERIES[args.name](spark, args.tables)
    else:
        result = ingest.ingest(ingest.read_documents(spark, args.path, args.extensions).where("error is null"))
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=80)


if __name__ == "__main__":
    main()
