"""Command line: list the queries, print the SQL of one, or run one over a data folder."""

from __future__ import annotations

import argparse
import importlib

from . import plans
from .runtime import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--module", action="append", default=[], help="a further module with queries() and, if it has any, oracle_sql()")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("sql", help="the SQL of a query").add_argument("name")
    run = sub.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder with one Parquet table for each name")
    run.add_argument("--out", help="folder to write the result to as Parquet; else its first rows are shown")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--cpus", type=int, default=8)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    modules = [importlib.import_module(m) for m in args.module]
    queries = {**plans.queries(), **{k: f for m in modules for k, f in m.queries().items()}}
    sql = {**plans.oracle_sql(), **{k: q for m in modules if hasattr(m, "oracle_sql") for k, q in m.oracle_sql().items()}}
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.name not in (sql if args.command == "sql" else queries):
        print(f"no {'SQL for' if args.command == 'sql' else 'query'} {args.name}")
        return 2
    if args.command == "sql":
        print(sql[args.name])
        return 0
    df = queries[args.name](session(cpus=args.cpus), args.data)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
