"""Run statements of the SQL dialect: python -m tallyframe [-p NAME=PARQUET]... [STATEMENT]...; without one, a prompt."""

from __future__ import annotations

import argparse
import sys

from tallyframe.manager import FrameManager
from tallyframe.session import build_session


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    args.add_argument("-p", "--parquet", action="append", default=[], metavar="NAME=PATH", help="register a Parquet table")
    args.add_argument("--master", default=None, help="for example local[8]; default: what spark-submit says")
    args.add_argument("--rows", type=int, default=1000, help="most rows to show")
    args.add_argument("statement", nargs="*")
    a = args.parse_args(argv)
    m = FrameManager(build_session(a.master))
    for pair in a.parquet:
        name, _, path = pair.partition("=")
        m.read_parquet(path, name)
    for text in a.statement or iter(lambda: input("> ") if sys.stdin.isatty() else sys.stdin.readline(), ""):
        if text.strip():
            try:
                print("\n".join(m.sql(text, a.rows)))
            except (ValueError, KeyError) as e:
                print(f"error: {e}", file=sys.stderr)
                if a.statement:
                    return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
