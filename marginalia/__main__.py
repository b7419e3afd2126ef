"""The commands of a review: ``python -m marginalia <command>`` in a work tree.

Rows reach the terminal one partition at a time. Messages go to a daily file
beside the log of records, or to standard error where that can't be opened.
"""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import display
from marginalia.functions.text import escaped, newlines
from marginalia.operators import feedback, tree
from marginalia.plans.session import LOG_FOLDER, Session
from marginalia.sources import log

logger = logging.getLogger("marginalia")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia")
    top.add_argument("--root", default=".", help="the work tree")
    top.add_argument("--debug", action="store_true", help="log details")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *flags: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        for flag in flags:
            own.add_argument(f"--{flag}", action="store_true")
        return own

    def kinds(own: argparse.ArgumentParser) -> None:
        for name in ("only", "exclude"):
            own.add_argument(f"--{name}", action="append", default=[], metavar="KIND")

    command("diff", "unreviewed hunks", "json")
    mark = command("mark", "add a verdict to the log", "quiet")
    mark.add_argument("--fingerprint", required=True)
    mark.add_argument("--verdict", default="approved")
    mark.add_argument("--check", default="review")
    mark.add_argument("--note")
    mark.add_argument("--path")
    mark.add_argument("--line", type=int)
    command("sync", "merge another log into this one").add_argument("--from", dest="remote", required=True, metavar="LOG")
    command("check", "fail if changes are unreviewed")
    command("scan", "files and their blocks", "json", "tree")
    review = command("review", "blocks left to review", "json", "all")
    review.add_argument("--target", action="append", default=[], help="file:PATH, rev:COMMIT or rev:FIRST..LAST")
    kinds(review)
    given = command("feedback", "blocks with their reviews", "include-approved")
    given.add_argument("--format", choices=("xml", "json"), default="xml")
    kinds(given)
    command("inspect", "one block, or its parts", "split").add_argument("--fingerprint", required=True)
    command("verify", "count attestations", "all").add_argument("--id")
    return top


def as_json(rows: DataFrame) -> Iterator[str]:
    """A JSON array, a row a line."""
    yield "["
    held = None
    for (row,) in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        if held is not None:
            yield f"  {held},"
        held = row
    if held is not None:
        yield f"  {held}"
    yield "]"


def texts(rows: DataFrame, *keys: str, **lines) -> Iterator[str]:
    """A line a row, in order of ``keys``; a path's heading comes before its first."""
    last = None
    for path, line in rows.orderBy(*keys).select("path", lines["line"]).toLocalIterator():
        if path != last:
            last = path
            yield f"File: {path}"
        yield line


def as_xml(found: DataFrame) -> Iterator[str]:
    yield "<feedback>"
    last = None
    for path, name, block in found.orderBy("path", "start_line", "ord").select("path", escaped(F.col("path")), feedback.as_xml()).toLocalIterator():
        if path != last:
            if last is not None:
                yield "  </file>"
            last = path
            yield f'  <file path="{name}">'
        yield block.removesuffix("\n")
    if last is not None:
        yield "  </file>"
    yield "</feedback>"


def output(session: Session, asked: argparse.Namespace) -> Iterator[str]:
    """The lines of a command's output; a failed check raises."""
    name = asked.command
    end = F.col("start_line") + newlines(F.col("content")) + F.when(F.col("content").endswith("\n"), 0).otherwise(1)
    if name == "diff":
        hunks = session.diff()
        shown = F.concat(F.lit("  ["), "status", F.lit("] L"), F.col("new_start").cast("string"), F.lit(" "), "fingerprint", F.lit("\n"), "diff_content")
        yield from as_json(hunks) if asked.json else texts(hunks, "path", "new_start", line=shown)
    elif name == "mark":
        session.mark(asked.fingerprint, asked.verdict, asked.check, asked.path, asked.line, asked.note)
        if not asked.quiet:
            yield f"Marked {asked.fingerprint} as {asked.verdict}"
    elif name == "sync":
        session.sync(log.read(session.spark, asked.remote))
        yield f"Merged {asked.remote}"
    elif name == "check":
        session.check()
        yield "All changes are reviewed"
    elif name == "scan":
        files, blocks = session.scan()
        if asked.tree:
            yield from as_json(tree.nodes(files.select("path", "hash")).orderBy("path"))
        elif asked.json:
            yield from as_json(files.join(blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "hash", "kind", "start_line", "content"))).alias("blocks")), "path", "left").orderBy("path"))
        else:
            yield from texts(blocks, "path", "ord", line=F.concat(F.lit("  "), "kind", F.lit(" L"), F.col("start_line").cast("string"), F.lit("-L"), end.cast("string"), F.lit(" "), "hash"))
    elif name == "review":
        left = session.review(["all"] if asked.all or not asked.target else asked.target, asked.only, asked.exclude)
        shown = display.listing(F.col("start_line"), end, F.col("hash"), F.col("kind"), F.col("content"))
        yield from as_json(left.orderBy("file_rank", "path", "place")) if asked.json else texts(left, "file_rank", "path", "place", line=shown)
    elif name == "feedback":
        found = session.feedback(asked.include_approved, asked.only, asked.exclude)
        yield from as_json(found.orderBy("path", "start_line", "ord")) if asked.format == "json" else as_xml(found)
    elif name == "inspect":
        found = session.inspect(asked.fingerprint, asked.split)
        yield from as_json(found.orderBy("sub_ord") if asked.split else found)
    elif name == "verify":
        counts = session.verify(asked.id).first()
        yield from (f"{n.capitalize()}: {counts[n]}" for n in ("attested", "unattested", "invalid"))
        if counts["invalid"]:
            raise RuntimeError("attestations don't hold")


def daily_log(root: str, debug: bool) -> logging.Handler:
    """Sends messages to the day's file in the log's folder."""
    folder = os.path.join(log.root(root, LOG_FOLDER), LOG_FOLDER, "logs")
    try:
        os.makedirs(folder, exist_ok=True)
        handler: logging.Handler = logging.FileHandler(os.path.join(folder, f"{datetime.date.today().isoformat()}.log"), encoding="utf-8")
    except OSError as error:
        handler = logging.StreamHandler()
        logger.warning("no log file: %s", error)
    handler.setFormatter(logging.Formatter("[%(levelname)s] [%(asctime)s] [%(threadName)s] [%(module)s:%(lineno)d] [%(message)s]"))
    logger.addHandler(handler)
    logger.setLevel(logging.DEBUG if debug else logging.WARNING)
    return handler


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    handler = daily_log(asked.root, asked.debug)
    try:
        logger.debug("asked for %s", json.dumps(vars(asked)))
        for line in output(Session(spark or SparkSession.builder.appName("marginalia").getOrCreate(), asked.root), asked):
            print(line)
        return 0
    except (RuntimeError, ValueError) as error:
        logger.error("%s", error)
        print(f"error: {error}", file=sys.stderr)
        return 1
    finally:
        logger.removeHandler(handler)
        handler.close()


if __name__ == "__main__":
    sys.exit(main())
