"""Commands over a corpus: ``python -m tarnwell.cli COMMAND --root FOLDER [--tables FOLDER]``."""

from __future__ import annotations

import argparse
import csv
import json
import sys
import uuid
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.plans import catalog

#: Stages that are commands of their own.
STAGES = ("skills", "ingest", "embed", "cluster", "terms", "community", "classify", "trajectory", "conflicts", "friction")
FORMATS = ("auto", "table", "json", "ndjson", "csv")


def emit(df: DataFrame, form: str = "auto", out: TextIO | None = None) -> None:
    """All rows to a stream, a partition at a time: a table for people, else JSON lines."""
    out = out or sys.stdout
    if form == "auto":
        form = "table" if out.isatty() else "ndjson"
    if form in ("json", "ndjson"):
        lines = (r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())
        if form == "ndjson":
            out.writelines(f"{line}\n" for line in lines)
            return
        some = False
        for line in lines:
            out.write(("[" if not some else ", ") + line)
            some = True
        out.write("]\n" if some else "[]\n")
        return
    rows = df.select(*[F.coalesce((F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"c{i}") for i, (c, kind) in enumerate(df.dtypes)])
    if form == "csv":
        sheet = csv.writer(out, lineterminator="\n")
        sheet.writerow(df.columns)
        sheet.writerows(map(tuple, rows.toLocalIterator()))
        return
    widest = rows.agg(*[F.max(F.length(c)).alias(c) for c in rows.columns]).first()
    widths = [max(len(name), w or 0) for name, w in zip(df.columns, widest, strict=True)]
    line = lambda cells: "  ".join(str(x).rjust(w) for x, w in zip(cells, widths, strict=True)) + "\n"
    out.write(line(df.columns))
    out.writelines(map(line, rows.toLocalIterator()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnwell")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **kinds: Any) -> None:
        p = commands.add_parser(name)
        p.add_argument("--root")
        p.add_argument("--tables")
        p.add_argument("--format", choices=FORMATS, default="auto")
        for a in args:
            p.add_argument(a, **kinds.get(a.lstrip("-").replace("-", "_"), {}))

    whole = {"type": int}
    command("query", "sql")
    command("explain", "sql")
    command("schema")
    command("macros")
    command("list-cache")
    command("peek", "session")
    command("search", "text", "--k", "--session", k=whole | {"default": 10})
    command("compact", "table", "--apply", apply={"action": "store_true"})
    command("migrate", "table", "--apply", apply={"action": "store_true"})
    command("analyze", "--apply", "--days", "--limit", "--skip", apply={"action": "store_true"}, days=whole, limit=whole, skip={"default": ""})
    for stage in STAGES:
        command(stage, "--apply", "--days", "--limit", apply={"action": "store_true"}, days=whole, limit=whole)
    command("skills-ls", "--kind", "--plugin")
    command("shell")
    command("watch", "--flushes", flushes=whole)
    return top


def run(args: argparse.Namespace) -> int:
    from pathlib import Path

    from tarnwell.operators import transcript
    from tarnwell.session import session
    from tarnwell.sources import store

    put = lambda x: sys.stdout.write(json.dumps(x, ensure_ascii=False, default=str) + "\n")
    if args.command == "schema":
        put(catalog.schema())
        return 0
    if args.command == "macros":
        put(dict(catalog.list_macros()))
        return 0
    if args.command == "list-cache":
        put(catalog.list_cache(args.tables))
        return 0
    if args.command == "migrate":
        put({"table": args.table, "migrated": store.to_folder(Path(args.tables) / args.table, dry_run=not args.apply)})
        return 0
    spark = session()
    corpus = catalog.Corpus(spark, args.root, tables=args.tables)
    if args.command == "query":
        emit(corpus.sql(args.sql), args.format)
    elif args.command == "explain":
        sys.stdout.write(corpus.explain(args.sql) + "\n")
    elif args.command == "peek":
        found = transcript.peek(corpus.views["messages"], corpus.views["messages_text"], corpus.views["tool_calls"], args.session)
        if found is None:
            raise KeyError(args.session)
        put(found)
    elif args.command == "search":
        found = corpus.search(args.text, args.k, args.session)
        if found is None:
            return catalog.NO_EMBEDDINGS
        emit(found, args.format)
    elif args.command == "skills-ls":
        emit(corpus.skills(args.kind, args.plugin), args.format)
    elif args.command == "compact":
        put(store.compact(spark, Path(args.tables) / args.table, dry_run=not args.apply))
    elif args.command in STAGES:
        from tarnwell.plans.analyze import run_analyze

        put(run_analyze(corpus, dry_run=not args.apply, days=args.days, limit=args.limit, skip=tuple(s for s in STAGES if s != args.command)))
    elif args.command == "shell":
        for line in sys.stdin:
            if line.strip():
                try:
                    emit(corpus.sql(line.strip().rstrip(";")), args.format)
                except Exception as error:  # noqa: BLE001  the next line is another query
                    sys.stderr.write(f"{type(error).__name__}: {error}\n")
    elif args.command == "analyze":
        from tarnwell.plans.analyze import run_analyze

        put(run_analyze(corpus, dry_run=not args.apply, days=args.days, limit=args.limit, skip=tuple(args.skip.split(","))))
    elif args.command == "watch":
        from tarnwell.plans import checkpoints
        from tarnwell.streaming import watch

        pattern = corpus._glob("events")
        checkpoints.ready(spark)
        totals = watch.watch(watch.RawTable(spark, pattern), f"{spark.sparkContext.getCheckpointDir()}/watch-{uuid.uuid4().hex}", most_flushes=args.flushes)
        put(vars(totals))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except Exception as error:  # noqa: BLE001  every failure has an exit code
        sys.stderr.write(json.dumps({"error": type(error).__name__, "message": str(error)[:2000]}) + "\n")
        return catalog.exit_code(error)


if __name__ == "__main__":
    sys.exit(main())
