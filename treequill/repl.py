"""python -m treequill.repl [-D name=value] FILE...: queries over JSON files, one document each."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .diagnostics import diagnose
from .errors import QueryError
from .plans.session import Session
from .sources.documents import read_json

HELP = "/any  /wildcard  /verbose  toggle options;  /quit  ends"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treequill", description=__doc__)
    parser.add_argument("-D", "--define", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--query", action="append", default=[], help="run this query and go on to the next; no prompt")
    parser.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    session = Session(constants=dict(d.split("=", 1) for d in args.define))
    spark = SparkSession.builder.appName("treequill").getOrCreate()
    docs = read_json(spark, args.files).cache()
    options = {"any": False, "wildcard": False, "verbose": False}
    lines = iter(args.query) if args.query else _prompt()
    for line in lines:
        if line.startswith("/"):
            if line == "/quit":
                break
            name = line[1:]
            if name in options:
                options[name] = not options[name]
            print(f"{name} is {'on' if options[name] else 'off'}" if name in options else HELP)
            continue
        began = time.perf_counter()
        try:
            query = session.compile(line, any=options["any"], auto_wildcard=options["wildcard"])
            for row in session.query(docs, "doc", query, ["root_id"]).orderBy("root_id", "pos").toLocalIterator():
                print(row["text"])
            for text, where in query.warnings:
                print(f"warning: {text}: {where}", file=sys.stderr)
            if options["verbose"]:
                print(query.to_sexpr(), f"{1000 * (time.perf_counter() - began):.0f} ms", *[m.text for m in diagnose(session, docs, "doc", line).messages()], sep="\n")
        except QueryError as e:
            if e.offset >= 0:
                print(line, " " * e.offset + "^" * max(e.size, 1), sep="\n", file=sys.stderr)
            print(f"error: {e.message}", file=sys.stderr)
        except PySparkException as e:
            print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
    return 0


def _prompt():
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        if line:
            yield line


if __name__ == "__main__":
    sys.exit(main())
