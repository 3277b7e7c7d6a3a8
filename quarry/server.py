"""The engine over HTTP, with the standard library's server: one JSON object in, one out."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from quarry.engine import Quarry
from quarry.errors import InvalidQueryError, QuarryError

log = logging.getLogger(__name__)
#: Called with the engine, the path's parts, the query's parameters and the body's text.
Handler = Callable[[Quarry, dict[str, str], dict[str, str], str], tuple[int, Any]]
ROUTES: list[tuple[str, re.Pattern, Handler]] = []


def route(method: str, path: str) -> Callable[[Handler], Handler]:
    rule = re.compile(re.sub(r"<(\w+)>", r"(?P<\1>[^/]+)", path) + "$")

    def add(f: Handler) -> Handler:
        ROUTES.append((method, rule, f))
        return f

    return add


def _json(body: str, need: tuple[str, ...] = ()) -> dict[str, Any]:
    try:
        got = json.loads(body) if body.strip() else {}
    except ValueError as e:
        raise InvalidQueryError(f"the body is no JSON: {e}") from None
    if not isinstance(got, dict):
        raise InvalidQueryError("the body must be a JSON object")
    missing = [k for k in need if k not in got]
    if missing:
        raise InvalidQueryError(f"the body lacks {missing[0]!r}")
    return got


def _number(params: dict[str, str], name: str, other: int | None) -> int | None:
    if name not in params:
        return other
    try:
        return int(params[name])
    except ValueError:
        raise InvalidQueryError(f"{name!r} must be a whole number") from None


@route("GET", "/")
@route("GET", "/_info")
def _info(q, at, params, body):
    return 200, q.info()


@route("GET", "/_health")
@route("GET", "/_cluster/health")
def _health(q, at, params, body):
    return 200, {"status": "green", "number_of_indices": len(q.list_indices()), "active_jobs": sum(j["state"] == "running" for j in q.jobs().values())}


@route("GET", "/_cat/indices")
def _cat(q, at, params, body):
    return 200, [{"index": n, **q.stats(n)} for n in q.list_indices()]


@route("GET", "/_plugins")
def _plugins(q, at, params, body):
    return 200, {"plugins": q.plugins}


@route("POST", "/_bulk")
@route("POST", "/<index>/_bulk")
def _bulk(q, at, params, body):
    return 200, q.bulk(body, at.get("index"))


@route("POST", "/_ingest/file")
def _ingest(q, at, params, body):
    b = _json(body, ("path", "index"))
    chain, how = b.get("processors", []), {"regex": b.get("regex"), "multiline": b.get("multiline"), "id_mode": b.get("id_mode", "offset")}
    if "checkpoint" not in b:
        return 200, {"index": b["index"], "live_count": q.ingest_file(b["path"], b["index"], chain, **how)}
    q.follow(b["path"], b["index"], b["checkpoint"], chain, start=b.get("from", "checkpoint"), once=not b.get("follow", False), **how)
    return 202, {"job": b["checkpoint"]}


@route("GET", "/_ingest/jobs")
def _jobs(q, at, params, body):
    return 200, q.jobs()


@route("GET", "/_ingest/jobs/<job>")
def _job(q, at, params, body):
    return 200, q.job(at["job"])


@route("DELETE", "/_ingest/jobs/<job>")
def _stop(q, at, params, body):
    return 200, q.stop(at["job"])


@route("PUT", "/<index>")
def _create(q, at, params, body):
    q.create_index(at["index"], _json(body).get("mappings"))
    return 200, {"acknowledged": True, "index": at["index"]}


@route("GET", "/<index>")
def _show(q, at, params, body):
    return 200, {at["index"]: {"mappings": q.get_mapping(at["index"]), "stats": q.stats(at["index"])}}


@route("HEAD", "/<index>")
def _there(q, at, params, body):
    return (200 if q.exists(at["index"]) else 404), None


@route("DELETE", "/<index>")
def _delete(q, at, params, body):
    q.delete_index(at["index"])
    return 200, {"acknowledged": True}


@route("PUT", "/<index>/_mapping")
def _mapping(q, at, params, body):
    return 200, {at["index"]: {"mappings": q.update_mapping(at["index"], _json(body))}}


@route("POST", "/<index>/_refresh")
def _refresh(q, at, params, body):
    q.refresh(at["index"])
    return 200, {"acknowledged": True}


@route("POST", "/<index>/_forcemerge")
def _merge(q, at, params, body):
    q.force_merge(at["index"])
    return 200, {"acknowledged": True}


@route("GET", "/<index>/_stats")
def _stats(q, at, params, body):
    return 200, {at["index"]: q.stats(at["index"])}


@route("POST", "/<index>/_doc")
@route("PUT", "/<index>/_doc/<id>")
def _put(q, at, params, body):
    (key,) = q.index_documents(at["index"], [_json(body)], [at.get("id")])
    return 201, {"_index": at["index"], "_id": key, "result": "created"}


@route("GET", "/<index>/_doc/<id>")
def _get(q, at, params, body):
    doc = q.get_document(at["index"], at["id"])
    found = {"_source": doc} if doc is not None else {}
    return (200 if doc is not None else 404), {"_index": at["index"], "_id": at["id"], "found": doc is not None, **found}


@route("DELETE", "/<index>/_doc/<id>")
def _remove(q, at, params, body):
    hit = q.delete_document(at["index"], at["id"])
    return (200 if hit else 404), {"_index": at["index"], "_id": at["id"], "result": "deleted" if hit else "not_found"}


@route("GET", "/<index>/_search")
def _ask(q, at, params, body):
    return 200, q.search(at["index"], params.get("q", "*"), _number(params, "size", None), _number(params, "from", 0))


@route("POST", "/<index>/_search")
def _search(q, at, params, body):
    return 200, q.search(at["index"], _json(body))


@route("POST", "/<index>/_pql")
def _pql(q, at, params, body):
    b = _json(body, ("query",))
    return 200, q.search(at["index"], b["query"], b.get("size"), b.get("from", 0))


@route("POST", "/<index>/_analyze")
def _analyze(q, at, params, body):
    b = _json(body, ("text",))
    name = b.get("analyzer")
    if name is None and "field" in b:
        name = q.get_mapping(at["index"]).get(b["field"], {}).get("analyzer")
    return 200, {"tokens": [{"token": t, "position": p} for t, p in q.analyze(b["text"], name or "standard")]}


def answer(q: Quarry, method: str, target: str, body: str) -> tuple[int, Any]:
    """(status, what to return as JSON) for a request."""
    url = urlsplit(target)
    hits = [(m, f, x) for m, rule, f in ROUTES if (x := rule.match(url.path))]
    own = [(f, x) for m, f, x in hits if m == method]
    try:
        if not own:
            raise InvalidQueryError(f"{method} isn't answered at {url.path}") if hits else InvalidQueryError(f"there is nothing at {url.path}")
        f, x = own[0]
        return f(q, {k: unquote(v) for k, v in x.groupdict().items()}, {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}, body)
    except QuarryError as e:
        status = e.status if own else 405 if hits else 404
        return status, {"error": e.to_dict(), "status": status}
    except Exception:
        log.exception("%s %s failed", method, target)
        return 500, {"error": {"type": "engine_error", "reason": "the request failed; see the log"}, "status": 500}


def server(q: Quarry, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server, not yet started, for :meth:`serve_forever`."""

    class Answer(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, got = answer(q, self.command, self.path, body)
            out = b"" if got is None else json.dumps(got, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = _do

        def log_message(self, form: str, *args: Any) -> None:
            log.info(form, *args)

    return ThreadingHTTPServer((host or q.settings.host, q.settings.port if port is None else port), Answer)
