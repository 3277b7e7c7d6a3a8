"""Typed mappings: explicit, inferred, merged; coercion of documents."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from quarry.errors import MappingError

TYPES = ("text", "keyword", "long", "double", "boolean", "date", "object")
SPARK_TYPES = {"keyword": "string", "long": "bigint", "double": "double", "boolean": "boolean", "date": "bigint"}
DYNAMIC_IGNORE_ABOVE = 256
INDEX_OPTIONS = ("docs", "freqs", "positions")


@dataclass(frozen=True)
class FieldMapping:
    type: str
    analyzer: str | None = None
    search_analyzer: str | None = None
    index: bool = True
    store: bool = True
    index_options: str = "positions"
    ignore_above: int | None = None

    @property
    def query_analyzer(self) -> str:
        return self.search_analyzer or self.analyzer or "standard"


@dataclass
class Mapping:
    fields: dict[str, FieldMapping] = field(default_factory=dict)

    def text_fields(self) -> list[str]:
        return sorted(k for k, f in self.fields.items() if f.type == "text")

    def to_dict(self) -> dict[str, Any]:
        return {k: {a: v for a, v in asdict(f).items() if v != FieldMapping.__dataclass_fields__[a].default} for k, f in sorted(self.fields.items())}

    @classmethod
    def from_dict(cls, flat: dict[str, Any]) -> Mapping:
        return cls({k: FieldMapping(**v) for k, v in flat.items()})


def parse_mapping(body: dict[str, Any] | None) -> Mapping:
    """``{"properties": {...}}`` flattened to dotted paths."""
    out: dict[str, FieldMapping] = {}

    def visit(props: Any, prefix: str) -> None:
        if not isinstance(props, dict):
            raise MappingError(f"properties of {prefix or 'the mapping'!r} must be an object")
        for name, spec in props.items():
            path = f"{prefix}{name}"
            kind = spec.get("type", "object" if "properties" in spec else None) if isinstance(spec, dict) else None
            if kind not in TYPES:
                raise MappingError(f"field {path!r} has no known type: {kind!r}")
            if kind == "object":
                visit(spec.get("properties"), f"{path}.")
                continue
            if path in out:
                raise MappingError(f"field {path!r} is mapped twice")
            how = {k: spec[k] for k in FieldMapping.__dataclass_fields__ if k in spec}
            if how.get("index_options", "positions") not in INDEX_OPTIONS:
                raise MappingError(f"field {path!r}: unknown index_options {how['index_options']!r}")
            out[path] = FieldMapping(**how)

    if body:
        visit(body.get("properties", {}), "")
    return Mapping(out)


def merge(old: Mapping, new: Mapping) -> Mapping:
    for k, f in new.fields.items():
        if k in old.fields and old.fields[k].type != f.type:
            raise MappingError(f"field {k!r} is mapped as {old.fields[k].type!r}, not {f.type!r}")
    return Mapping({**new.fields, **old.fields})


def flatten(doc: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in doc.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def _inferred(value: Any) -> str | None:
    if isinstance(value, list):
        value = next((x for x in value if x is not None), None)
    for kind, name in ((bool, "boolean"), (int, "long"), (float, "double"), (str, "text")):
        if isinstance(value, kind):
            return name
    return None


def infer(mapping: Mapping, docs: Iterable[dict[str, Any]]) -> Mapping:
    """``mapping`` with the fields that ``docs`` add; the first document decides. A new
    string is text with a keyword companion; dates aren't detected."""
    found = dict(mapping.fields)
    for doc in docs:
        for path, value in flatten(doc).items():
            kind = _inferred(value) if path not in found else None
            if kind:
                found[path] = FieldMapping(kind)
                if kind == "text":
                    found.setdefault(f"{path}.keyword", FieldMapping("keyword", ignore_above=DYNAMIC_IGNORE_ABOVE))
    return Mapping(found)


def parse_millis(value: str) -> int:
    """ISO-8601 text to UTC epoch milliseconds (half-even); naive times are UTC."""
    try:
        at = datetime.fromisoformat(value)
    except (ValueError, TypeError):
        raise MappingError(f"{value!r} is not an ISO-8601 time") from None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    delta = at - datetime(1970, 1, 1, tzinfo=UTC)
    return round(((delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds) / 1000)


def coerce(path: str, kind: str, value: Any) -> Any:
    """A document's value as ``kind`` holds it; MappingError where it can't be."""
    plain = not isinstance(value, bool)
    if kind == "text":
        return value if isinstance(value, str) else str(value)
    if kind == "keyword" and isinstance(value, str):
        return value
    if kind == "long" and plain and isinstance(value, int) and -(2**63) <= value < 2**63:
        return value
    if kind == "double" and plain and isinstance(value, int | float) and not math.isnan(value):
        return float(value) + 0.0
    if kind == "boolean" and not plain:
        return value
    if kind == "date" and isinstance(value, str):
        return parse_millis(value)
    raise MappingError(f"field {path!r} of type {kind!r} can't hold {value!r}")


def validate(mapping: Mapping, doc: dict[str, Any]) -> None:
    for path, value in flatten(doc).items():
        f = mapping.fields.get(path)
        for x in value if isinstance(value, list) else [value]:
            if f is not None and f.index and x is not None and not isinstance(x, dict):
                coerce(path, f.type, x)
