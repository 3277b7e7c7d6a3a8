"""The JSON query body. Whatever isn't supported is refused by name, never ignored."""

from __future__ import annotations

from typing import Any

from quarry.errors import InvalidQueryError, UnsupportedFeatureError
from quarry.mapping import Mapping
from quarry.plans import resolve
from quarry.plans.ast import Bool, Exists, MatchAll, Query, Search, Sort, TermsAgg, boosted

TOP = {"query", "from", "size", "sort", "_source", "aggs", "aggregations"}


def _known(given: Any, allowed: set[str], where: str) -> dict:
    if not isinstance(given, dict):
        raise InvalidQueryError(f"{where} must be an object")
    if extra := sorted(set(given) - allowed):
        raise UnsupportedFeatureError(f"{where} doesn't support {', '.join(map(repr, extra))}")
    return given


def _one(body: Any, where: str) -> tuple[str, Any]:
    if not isinstance(body, dict) or len(body) != 1:
        raise InvalidQueryError(f"{where} takes exactly one key")
    return next(iter(body.items()))


def _boost(body: dict, where: str) -> float:
    b = body.get("boost", 1.0)
    if isinstance(b, bool) or not isinstance(b, int | float):
        raise InvalidQueryError(f"the boost of {where} must be a number")
    return float(b)


def _leaf(body: Any, where: str, key: str) -> tuple[str, Any, float]:
    field, raw = _one(body, where)
    if not isinstance(raw, dict):
        return field, raw, 1.0
    _known(raw, {key, "value", "boost"}, f"{where} on {field!r}")
    if key not in raw and "value" not in raw:
        raise InvalidQueryError(f"{where} on {field!r} lacks {key!r}")
    return field, raw.get(key, raw.get("value")), _boost(raw, where)


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str):
        raise InvalidQueryError(f"{where} takes a string, not {value!r}")
    return value


def clause(mapping: Mapping, body: Any) -> Query:
    name, value = _one(body, "a query clause")
    if name == "match_all":
        _known(value, set(), "match_all")
        return MatchAll()
    if name in ("match", "term"):
        field, raw, boost = _leaf(value, name, "query" if name == "match" else "value")
        return boosted(resolve.term(mapping, field, raw), boost)
    if name == "match_phrase":
        field, raw, boost = _leaf(value, name, "query")
        return boosted(resolve.phrase(mapping, field, _text(raw, name)), boost)
    if name == "prefix":
        field, raw, boost = _leaf(value, name, "value")
        return boosted(resolve.prefix(mapping, field, _text(raw, name)), boost)
    if name == "terms":
        if not isinstance(value, dict):
            raise InvalidQueryError("terms must be an object")
        field, listed = _one({k: v for k, v in value.items() if k != "boost"}, name)
        if not isinstance(listed, list) or not listed:
            raise InvalidQueryError(f"terms on {field!r} takes a list of at least one value")
        each = tuple(resolve.term(mapping, field, v) for v in listed)
        return boosted(each[0] if len(each) == 1 else Bool(should=each), _boost(value, name))
    if name == "range":
        field, bounds = _one(value, name)
        _known(bounds, {"gte", "gt", "lte", "lt", "boost"}, f"range on {field!r}")
        return boosted(resolve.span(mapping, field, **{k: v for k, v in bounds.items() if k != "boost"}), _boost(bounds, name))
    if name == "exists":
        return Exists(_text(_known(value, {"field"}, name).get("field"), "exists.field"))
    if name == "bool":
        _known(value, {"must", "should", "must_not", "filter", "boost"}, name)
        parts = {}
        for k in ("must", "should", "must_not", "filter"):
            listed = value.get(k, [])
            listed = [listed] if isinstance(listed, dict) else listed
            if not isinstance(listed, list):
                raise InvalidQueryError(f"bool.{k} takes a clause or a list of clauses")
            parts[k] = tuple(clause(mapping, c) for c in listed)
        return boosted(Bool(**parts), _boost(value, name))
    raise UnsupportedFeatureError(f"the query clause {name!r} isn't supported")


DIRECTIONS = {"asc": False, "desc": True}


def _sort(item: Any) -> Sort:
    """``"f"``, ``"-f"``, ``{"f": "desc"}`` or ``{"f": {"order": "desc"}}``."""
    match item:
        case str():
            name = item.removeprefix("-")
            return Sort(name, name != item)
        case {**entry} if len(entry) == 1:
            ((name, how),) = entry.items()
            match how:
                case {"order": str(way)} | str(way) if way.lower() in DIRECTIONS:
                    return Sort(name, DIRECTIONS[way.lower()])
    raise InvalidQueryError(f"this sort entry isn't supported: {item!r}")


def _buckets(name: str, spec: Any) -> TermsAgg:
    match spec:
        case {"terms": body, **others} if not others:
            what = f"terms of aggregation {name!r}"
            body = _known(body, {"field", "size"}, what)
            match body.get("size", 10):
                case int(n) if n >= 1 and n is not True:
                    return TermsAgg(_text(body.get("field"), f"the field in {what}"), n)
            raise InvalidQueryError(f"{what}: its size must be a positive integer")
    raise UnsupportedFeatureError(f"aggregation {name!r} isn't supported: only 'terms' is")


def _aggs(given: Any) -> tuple[tuple[str, TermsAgg], ...]:
    if isinstance(given, dict):
        return tuple((name, _buckets(name, spec)) for name, spec in given.items())
    raise InvalidQueryError("aggs must be an object")


def _count(body: dict, key: str, default: int) -> int:
    n = body.get(key, default)
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise InvalidQueryError(f"{key!r} must be an integer of at least 0")
    return n


def compile_body(mapping: Mapping, body: Any) -> Search:
    _known(body, TOP, "the search body")
    if "aggs" in body and "aggregations" in body:
        raise InvalidQueryError("give 'aggs' or 'aggregations', not both")
    sort = body.get("sort") if body.get("sort") is not None else []
    source = body.get("_source", True)
    if isinstance(source, str | list):
        source = tuple(_text(x, "_source") for x in ([source] if isinstance(source, str) else source))
    elif not isinstance(source, bool):
        raise InvalidQueryError("_source must be a boolean, a field or a list of fields")
    return Search(
        MatchAll() if body.get("query") is None else clause(mapping, body["query"]),
        _count(body, "from", 0), _count(body, "size", 10), tuple(map(_sort, sort if isinstance(sort, list) else [sort])),
        source, _aggs(body.get("aggs", body.get("aggregations", {}))),
    )
