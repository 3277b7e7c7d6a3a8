"""python -m quarry.cli: indices, documents, searches and ingest from a shell."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quarry.engine import VERSION, Quarry
from quarry.errors import InvalidQueryError, QuarryError
from quarry.settings import load_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--root")
    p.add_argument("--settings")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, args in {
        "create": ["index", "--mapping"], "list": [], "show": ["index"], "delete": ["index"], "stats": ["index"], "refresh": ["index"], "merge": ["index"],
        "put": ["index", "document", "--id"], "get": ["index", "id"], "remove": ["index", "id"], "bulk": ["file", "--index"],
        "search": ["index", "query", "--size", "--from", "--dsl"], "analyze": ["text", "--analyzer"],
        "version": [], "info": [], "plugins": [], "map": ["index", "mapping"], "serve": ["--host", "--port"], "status": ["checkpoints"], "reset": ["checkpoint", "--index"],
        "ingest": ["file", "index", "--processor", "--regex-pattern", "--multiline-start", "--id-mode", "--checkpoint"],
    }.items():
        s = sub.add_parser(verb)
        for a in args:
            if a == "--dsl":
                s.add_argument(a, action="store_true")
            elif a == "--processor":
                s.add_argument(a, action="append", default=[])
            else:
                s.add_argument(a, **({"type": int} if a in ("--size", "--from", "--port") else {}))
    return p


def _object(text: str) -> dict:
    try:
        got = json.loads(text)
    except ValueError as e:
        raise InvalidQueryError(f"the query is no JSON: {e}") from None
    if not isinstance(got, dict):
        raise InvalidQueryError("the query must be a JSON object")
    return got


def run(engine: Quarry, a: argparse.Namespace):
    if a.verb == "create":
        return engine.create_index(a.index, json.loads(Path(a.mapping).read_text()) if a.mapping else None)
    if a.verb == "list":
        return engine.list_indices()
    if a.verb in ("show", "delete", "stats", "refresh", "merge"):
        return {"show": engine.get_mapping, "delete": engine.delete_index, "stats": engine.stats, "refresh": engine.refresh, "merge": engine.force_merge}[a.verb](a.index)
    if a.verb == "put":
        return engine.index_documents(a.index, [_object(a.document)], [a.id])
    if a.verb == "get":
        return engine.get_document(a.index, a.id)
    if a.verb == "remove":
        return engine.delete_document(a.index, a.id)
    if a.verb == "bulk":
        return engine.bulk(Path(a.file).read_text(), a.index)
    if a.verb == "search":
        if a.dsl:
            body = _object(a.query)
            given = {"size": a.size, "from": getattr(a, "from")}
            return engine.search(a.index, body | {k: v for k, v in given.items() if v is not None})
        return engine.search(a.index, a.query, a.size, getattr(a, "from") or 0)
    if a.verb == "analyze":
        return engine.analyze(a.text, a.analyzer or "standard")
    if a.verb == "info":
        return engine.info()
    if a.verb == "plugins":
        return engine.plugins
    if a.verb == "map":
        return engine.update_mapping(a.index, json.loads(Path(a.mapping).read_text()))
    if a.verb == "status":
        return engine.checkpoints(a.checkpoints)
    if a.verb == "reset":
        return engine.reset(a.checkpoint, a.index)
    if a.verb == "serve":
        from quarry.server import server

        with server(engine, a.host, a.port) as s:
            print(f"listening on {s.server_address[0]}:{s.server_address[1]}", file=sys.stderr, flush=True)
            s.serve_forever()
    if a.checkpoint:
        engine.follow(a.file, a.index, a.checkpoint, a.processor, a.regex_pattern, once=True, id_mode=a.id_mode or "offset", multiline=a.multiline_start).awaitTermination()
        return engine.stats(a.index)
    return engine.ingest_file(a.file, a.index, a.processor, a.regex_pattern, a.multiline_start, a.id_mode or "offset")


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "message": record.getMessage()})


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: the engine refused, 2: usage, 130: interrupted."""
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(VERSION)
        return 0
    try:
        settings = load_settings(a.settings)
        out = logging.StreamHandler()
        out.setFormatter(_JsonLines() if settings.log_format == "json" else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        logging.getLogger("quarry").handlers = [out]
        logging.getLogger("quarry").setLevel(settings.log_level)
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        print(json.dumps(run(Quarry(spark, a.root, settings), a), ensure_ascii=False, indent=2))
        return 0
    except QuarryError as e:
        print(json.dumps(e.to_dict()), file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
