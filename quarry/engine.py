"""The facade: indices, documents, searches, ingest and extension hooks."""

from __future__ import annotations

import json
import logging
from collections import defaultdict
from collections.abc import Callable
from datetime import datetime
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.errors import IngestError, InvalidQueryError, PluginError
from quarry.functions.analysis import ANALYZERS, Analyzer, analyzer
from quarry.operators.search import search
from quarry.plans import jsondsl, pql
from quarry.plans.ast import Search, TermsAgg
from quarry.settings import Settings
from quarry.sources.catalog import Catalog
from quarry.sources.lines import doc_id, read_lines
from quarry.streaming import processors, tail

log = logging.getLogger(__name__)
VERSION = "0.2"
EVENTS = ("index_created", "documents_indexed", "search")


class Quarry:
    def __init__(self, spark: SparkSession, root: str | None = None, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.catalog = Catalog(spark, root or self.settings.root)
        self.observers: dict[str, list[Callable[..., None]]] = defaultdict(list)
        self.streams: dict[str, Any] = {}
        self.plugins = self.load_plugins()

    # extension

    def info(self) -> dict[str, Any]:
        return {"name": "quarry", "version": VERSION, "spark": self.spark.version, "root": self.catalog.root, "indices": len(self.list_indices()), "plugins": self.plugins}

    def load_plugins(self) -> list[str]:
        """Entry points of the group ``quarry.plugins``: each is called with the engine. One
        that fails is skipped, or raised where plugins are strict."""
        loaded = []
        for ep in entry_points(group="quarry.plugins"):
            if self.settings.plugins and ep.name not in self.settings.plugins:
                continue
            try:
                ep.load()(self)
                loaded.append(ep.name)
            except Exception as e:
                if self.settings.strict_plugins:
                    raise PluginError(f"plugin {ep.name!r} failed: {e}") from e
                log.warning("plugin %r failed: %s", ep.name, e)
        return loaded

    def register_analyzer(self, name: str, made: Analyzer) -> None:
        ANALYZERS[name] = made

    def register_processor(self, name: str, made: processors.Processor) -> None:
        processors.PROCESSORS[name] = made

    def on(self, event: str, observer: Callable[..., None]) -> None:
        if event not in EVENTS:
            raise PluginError(f"there is no event {event!r}")
        self.observers[event].append(observer)

    def _tell(self, event: str, **what: Any) -> None:
        for observer in self.observers[event]:
            try:
                observer(**what)
            except Exception as e:  # an observer can't break the engine
                log.warning("observer of %s failed: %s", event, e)

    # indices

    def create_index(self, name: str, mapping: dict[str, Any] | None = None) -> None:
        self.catalog.create(name, mapping)
        self._tell("index_created", index=name)

    def delete_index(self, name: str) -> None:
        self.catalog.delete(name)

    def list_indices(self) -> list[str]:
        return self.catalog.names()

    def exists(self, name: str) -> bool:
        return self.catalog.exists(name)

    def get_mapping(self, name: str) -> dict[str, Any]:
        return self.catalog.mapping(name).to_dict()

    def update_mapping(self, name: str, mapping: dict[str, Any]) -> dict[str, Any]:
        """Adds fields; MappingError where one is mapped as another type."""
        return self.catalog.update_mapping(name, mapping).to_dict()

    def stats(self, name: str) -> dict[str, int]:
        return self.catalog.stats(name)

    def refresh(self, name: str) -> None:
        """Writes are visible at once; an index of too many commits is compacted."""
        if len(self.catalog.manifest(name)["commits"]) > self.settings.max_commits:
            self.catalog.compact(name)

    flush = refresh

    def force_merge(self, name: str) -> None:
        self.catalog.compact(name)

    # documents

    def index_documents(self, name: str, docs: list[dict[str, Any]], ids: list[str | None] | None = None) -> list[str]:
        if not self.exists(name):
            self.create_index(name)
        got = self.catalog.put(name, docs, ids)
        self._tell("documents_indexed", index=name, ids=got)
        return got

    def get_document(self, name: str, doc_id: str) -> dict[str, Any] | None:
        return self.catalog.get(name, doc_id)

    def delete_document(self, name: str, doc_id: str) -> bool:
        return self.catalog.remove(name, [doc_id])

    def bulk(self, lines: str, index: str | None = None) -> dict[str, Any]:
        """Newline-delimited actions, each index or create with a document after it, or
        delete; everything is parsed before anything is done, and runs of actions on one
        index are written together."""
        rows = [(n, x) for n, x in enumerate(lines.splitlines(), 1) if x.strip()]
        todo: list[tuple[str, str, str | None, dict | None]] = []
        at = 0
        while at < len(rows):
            n, text = rows[at]
            action, meta = self._bulk_json(n, text, one=True)
            if action not in ("index", "create", "delete"):
                raise InvalidQueryError(f"bulk line {n}: no such action: {action!r}")
            where = meta.get("_index", index)
            if not where:
                raise InvalidQueryError(f"bulk line {n}: no index is named")
            doc = None
            if action != "delete":
                at += 1
                if at >= len(rows):
                    raise InvalidQueryError(f"bulk line {n}: its document is missing")
                doc = self._bulk_json(*rows[at])
            elif not meta.get("_id"):
                raise InvalidQueryError(f"bulk line {n}: delete needs an _id")
            todo.append((action, where, meta.get("_id"), doc))
            at += 1
        items, k = [], 0
        while k < len(todo):
            action, where = todo[k][0] == "delete", todo[k][1]
            run = k
            while run < len(todo) and todo[run][1] == where and (todo[run][0] == "delete") == action and not (action and run > k):
                run += 1
            if action:
                hit = self.exists(where) and self.delete_document(where, todo[k][2])
                items.append({"delete": {"_index": where, "_id": todo[k][2], "status": 200 if hit else 404, "result": "deleted" if hit else "not_found"}})
            else:
                ids = self.index_documents(where, [d for *_, d in todo[k:run]], [i for _, _, i, _ in todo[k:run]])
                items += [{a: {"_index": where, "_id": i, "status": 201, "result": "created"}} for (a, *_), i in zip(todo[k:run], ids)]
            k = run
        return {"errors": False, "items": items}

    @staticmethod
    def _bulk_json(n: int, text: str, one: bool = False) -> Any:
        try:
            got = json.loads(text)
        except ValueError as e:
            raise InvalidQueryError(f"bulk line {n} is no JSON: {e}") from None
        if not isinstance(got, dict) or (one and (len(got) != 1 or not isinstance(next(iter(got.values())), dict))):
            raise InvalidQueryError(f"bulk line {n} isn't the object that belongs there")
        return next(iter(got.items())) if one else got

    # queries

    def search(self, name: str, query: str | dict[str, Any] | Search, size: int | None = None, from_: int = 0, now: datetime | None = None) -> dict[str, Any]:
        """``query`` in PQL, as a JSON body or as a Search."""
        index = self.catalog.frame(name)
        if isinstance(query, str):
            p = pql.parse(query, index.mapping, now)
            limit = p.limit if p.limit is not None else 10 if size is None else size
            aggs = (("stats", TermsAgg(p.stats)),) if p.stats else ()
            query = Search(p.query, from_, limit, p.sort, p.fields if p.fields is not None else True, aggs)
        elif isinstance(query, dict):
            query = jsondsl.compile_body(index.mapping, query)
        if query.size < 0 or query.from_ < 0:
            raise InvalidQueryError("'from' and 'size' must be at least 0")
        out = search(index, query, self.settings.max_sort_candidates)
        self._tell("search", index=name, response=out)
        return out

    def analyze(self, text: str, name: str = "standard") -> list[tuple[str, int]]:
        return analyzer(name).analyze(text)

    # ingest

    def ingest_file(self, path: str, name: str, chain: list[str] | None = None, regex: str | None = None, multiline: str | None = None, id_mode: str = "offset") -> int:
        """Files in one go; the number of live documents after it is returned."""
        if not self.exists(name):
            self.create_index(name)
        records = read_lines(self.spark, path, self.settings.max_line_bytes, multiline)
        key = doc_id(id_mode, F.col("message"), F.col("origin"), F.col("offset"))
        self.catalog.put_frame(name, processors.process(records, processors.resolve(chain or [], regex), key))
        return self.stats(name)["live_count"]

    def follow(self, path: str, name: str, checkpoint: str, chain: list[str] | None = None, regex: str | None = None, start: str = "checkpoint", once: bool = False, id_mode: str = "offset", multiline: str | None = None):
        """Growing files as a stream; ``once`` ends it when the input does, in one batch. The
        stream is a job, listed by :meth:`jobs` under its checkpoint."""
        s = self.settings
        records = tail.tail(self.spark, path, start, max_line_bytes=s.max_line_bytes, max_bytes=None if once else s.max_bytes_per_trigger, multiline=multiline, once=once, checkpoint=checkpoint)
        query = tail.ingest(records, self.catalog, name, processors.resolve(chain or [], regex), checkpoint, id_mode, None if once else s.trigger_seconds)
        self.streams[checkpoint] = query
        return query

    # jobs and checkpoints

    def jobs(self) -> dict[str, dict[str, Any]]:
        """State and progress of the streams that this engine started, by checkpoint."""
        return {k: self.job(k) for k in self.streams}

    def job(self, checkpoint: str) -> dict[str, Any]:
        query = self.streams.get(checkpoint)
        if query is None:
            raise IngestError(f"there is no job {checkpoint!r}")
        failed = query.exception()
        return {"state": "running" if query.isActive else "failed" if failed else "done", **({"error": str(failed)[:500]} if failed else {}), **tail.progress(query)}

    def stop(self, checkpoint: str) -> dict[str, Any]:
        """Ends a job after the batch it is at; its checkpoint stays."""
        self.job(checkpoint)
        self.streams[checkpoint].stop()
        return self.job(checkpoint)

    def checkpoints(self, root: str) -> dict[str, dict[str, Any]]:
        """The places that the streams with checkpoints directly below ``root`` have reached:
        file, byte and signature of each."""
        return {n: p for n in self.catalog.files.names(root) if (p := self.checkpoint(f"{root}/{n}"))}

    def checkpoint(self, path: str) -> dict[str, Any] | None:
        """What one checkpoint holds; None where there is none."""
        files = self.catalog.files
        done = [int(n) for n in files.names(f"{path}/commits") if n.isdigit()]
        if not done:
            return None
        lines = files.read(f"{path}/offsets/{max(done)}").splitlines()
        return {"batch": max(done), "files": {v["path"]: {"offset": v["at"], "signature": v["sig"]} for v in json.loads(json.loads(lines[-1])["files"]).values()}}

    def reset(self, checkpoint: str, name: str | None = None) -> bool:
        """Forgets a checkpoint, so that the next stream begins anew; whether there was one.
        Ids by offset make documents that are read again replace themselves. ``name``: the
        index, which forgets the stream's batches too."""
        if checkpoint in self.streams and self.streams[checkpoint].isActive:
            raise IngestError(f"the job {checkpoint!r} is running")
        there = bool(self.catalog.files.names(checkpoint))
        self.catalog.files.drop(checkpoint)
        for index in [name] if name else self.list_indices():
            self.catalog.forget(index, checkpoint)
        return there
