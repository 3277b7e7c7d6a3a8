"""The query AST that both languages compile to. Values are typed, not encoded."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class Term:
    field: str
    value: Any
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix:
    field: str
    value: str
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    field: str
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None
    boost: float = 1.0


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    filter: tuple = ()


Query = MatchAll | Term | Phrase | Prefix | Range | Exists | Bool

#: Matches nothing, for any mapping.
NO_MATCH = Phrase("", ())


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class TermsAgg:
    field: str
    size: int = 10


@dataclass(frozen=True)
class Search:
    """A whole request."""

    query: Query
    from_: int = 0
    size: int = 10
    sort: tuple[Sort, ...] = ()
    source: bool | tuple[str, ...] = True
    aggs: tuple[tuple[str, TermsAgg], ...] = ()


def boosted(q: Query, by: float) -> Query:
    """``by`` multiplied into every scored leaf; must_not, match-all and exists stay."""
    if by == 1.0:
        return q
    if isinstance(q, Bool):
        return replace(q, **{k: tuple(boosted(x, by) for x in getattr(q, k)) for k in ("must", "should", "filter")})
    return replace(q, boost=q.boost * by) if hasattr(q, "boost") else q


def conjunction(clauses: list[Query]) -> Query:
    """AND; a bare negation joins the must_not of the whole, so that it adds no score."""
    must = tuple(c for c in clauses if not _negation(c))
    return Bool(must=must, must_not=tuple(x for c in clauses if _negation(c) for x in c.must_not))


def _negation(q: Query) -> bool:
    return isinstance(q, Bool) and bool(q.must_not) and not (q.must or q.should or q.filter)


def to_dict(q: Query) -> dict[str, Any]:
    if isinstance(q, Bool):
        return {"bool": {k: [to_dict(x) for x in getattr(q, k)] for k in ("must", "should", "must_not", "filter")}}
    name = {MatchAll: "match_all"}.get(type(q), type(q).__name__.lower())
    return {name: {k: list(v) if isinstance(v, tuple) else v for k, v in vars(q).items()}}
