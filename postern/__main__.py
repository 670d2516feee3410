"""python -m postern analyze PATH... | indicators: the batch command."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from datetime import datetime, timezone

from postern import __version__

#: Formats that are one JSON document, the others are text a message.
JSON = ("json", "iocs", "summary")


def arguments(argv: list[str] | None) -> argparse.Namespace:
    from postern.operators.scoring import FAIL_ON

    p = argparse.ArgumentParser(prog="postern")
    p.add_argument("--version", action="version", version=f"postern {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("-f", "--format", choices=("text", *JSON, "html"), default="text")
    a.add_argument("-o", "--output", help="a file; for the HTML pages of several messages, a folder")
    a.add_argument("--org-domain", action="append", default=[])
    a.add_argument("--dns-snapshot")
    a.add_argument("--no-defang", action="store_true")
    a.add_argument("--fail-on", choices=tuple(FAIL_ON), default="suspicious")
    a.add_argument("-q", "--quiet", action="store_true", help="no text report, only the exit code")
    i = sub.add_parser("indicators")
    i.add_argument("-f", "--format", choices=("table", "json", "markdown"), default="table")
    return p.parse_args(argv)


def document(rows: Iterator[str], single: bool) -> Iterator[str]:
    """JSON texts as one document: the only one as it is, several as an array."""
    if single:
        yield from rows
        return
    sep = "[\n"
    for row in rows:
        yield sep + row
        sep = ",\n"
    yield "[]" if sep == "[\n" else "\n]"


def page_names(sources: Iterator[str]) -> Iterator[str]:
    """A page's file name for each source; a name that was given before gets a number."""
    given: dict[str, int] = {}
    for source in sources:
        stem = os.path.splitext(os.path.basename(source))[0]
        given[stem] = given.get(stem, 0) + 1
        yield f"{stem}{'' if given[stem] == 1 else f'-{given[stem]}'}.report.html"


def texts(reports, args: argparse.Namespace, single: bool) -> Iterator[str]:
    """What the chosen format says, piece by piece, in input order; rows come to the driver one partition at a time."""
    import json

    from postern.operators import report

    live = not args.no_defang
    dump = lambda row: json.dumps(row, ensure_ascii=False)
    if args.format == "summary":
        rows = report.summary(reports, live).orderBy("ord").drop("ord").toLocalIterator()
        return document((dump(r.asDict()) for r in rows), False)
    if args.format == "iocs" and not single:
        rows = report.merged_iocs(report.iocs(reports, live)).orderBy("first.ord", "first.pos", "value").select("type", "value").toLocalIterator()
        return document((dump(r.asDict()) for r in rows), False)
    made = (r.report for r in report.rendered(reports, args.format, datetime.now(timezone.utc).isoformat(), live).orderBy("ord").toLocalIterator())
    return document(made, single) if args.format in JSON else (text + "\n" for text in made)


def emit(reports, args: argparse.Namespace, single: bool) -> None:
    from postern.operators import report

    if args.format == "html":
        made = report.rendered(reports, "html", datetime.now(timezone.utc).isoformat(), not args.no_defang).orderBy("ord")
        names = page_names(r.source for r in made.select("source").toLocalIterator())
        folder = "" if single else args.output or "out"
        if folder:
            os.makedirs(folder, exist_ok=True)
        for name, row in zip(names, made.toLocalIterator(), strict=True):
            path = args.output if single and args.output else os.path.join(folder, name)
            with open(path, "w", encoding="utf-8") as f:
                f.write(row.report)
            print(f"wrote {path}", file=sys.stderr)
        return
    if args.format == "text" and args.quiet:
        return
    if args.output:
        os.makedirs(os.path.dirname(os.path.abspath(args.output)), exist_ok=True)
    out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout  # noqa: SIM115
    try:
        out.writelines(texts(reports, args, single))
        out.write("\n")
        if args.format == "text" and not single:
            for row in report.batch_table(reports).toLocalIterator():
                out.write(f"{row.score:4}  {row.verdict:16} {row.file}  {row.top_indicators}\n")
    finally:
        if args.output:
            out.close()
            print(f"wrote {args.output}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    """0 done, 1 a verdict reached --fail-on, 2 nothing to read, 3 nothing could be analysed."""
    for stream in (sys.stdout, sys.stderr):  # a message may hold any letter, whatever the locale
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    args = arguments(argv)
    from postern import catalog

    if args.command == "indicators":
        print(catalog.listing(args.format))
        return 0
    from pyspark.sql import SparkSession

    from postern.operators import report, scoring
    from postern.sources import messages
    from postern.triage import triage

    spark = SparkSession.builder.appName("postern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    raw = messages.scan(spark, *args.paths)
    if not (count := raw.count()):
        print("no messages found", file=sys.stderr)
        return 2
    dns = messages.dns_snapshot(spark, args.dns_snapshot) if args.dns_snapshot else None
    every = triage(raw, tuple(args.org_domain), dns).cache()
    try:
        for row in report.failures(every).orderBy("ord").toLocalIterator():
            print(f"failed to parse {row.source}: {row.error}", file=sys.stderr)
        reports = every.where("error is null")
        code = scoring.exit_code(reports, args.fail_on)
        if code != 3:
            emit(reports, args, count == 1)
        return code
    finally:
        every.unpersist()


if __name__ == "__main__":
    sys.exit(main())
