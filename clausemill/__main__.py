"""Run a registered query from a shell: `python -m clausemill list`, `python -m clausemill run NAME FOLDER [--out PATH]`."""

from __future__ import annotations

import argparse

from .plans import catalog
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clausemill")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of the registered queries")
    run = verbs.add_parser("run", help="run one over the tables of a folder")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet there; else show the first rows")
    run.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.verb == "list":
        print(*sorted(catalog.queries()), sep="\n")
        return 0
    result = catalog.queries()[args.name](local_session(), args.folder)
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
