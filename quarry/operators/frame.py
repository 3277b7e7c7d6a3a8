"""An index as one DataFrame: ``doc_ord``, ``doc_id``, a typed column for each exact field,
and for each text field ``<f>__terms``, ``<f>__pos`` (where positions have gaps) and
``<f>__dl``, the length clamped to 255. ``<f>__raw`` holds the value as given.

Fields from JSON may hold several values, so their exact columns are arrays (``multi``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.analysis import analyzer, iso_millis, let, millis
from quarry.mapping import SPARK_TYPES, FieldMapping, Mapping

MAX_DL = 255
ARRAY_GAP = 100


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class IndexFrame:
    df: DataFrame
    mapping: Mapping
    name: str = "index"
    multi: bool = False
    #: Stored postings of the live documents, and what is known of them: n, and the sum of
    #: lengths of each field. Without them text leaves read the terms of all documents.
    postings: DataFrame | None = None
    live: dict[str, Any] | None = None
    commits: int = 1
    columns: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.columns = set(self.df.columns)

    def held(self, name: str) -> FieldMapping | None:
        """The mapping of an indexed field that this frame has a column for."""
        f = self.mapping.fields.get(name)
        have = f is not None and f.index and (f"{name}__dl" if f.type == "text" else name) in self.columns
        return f if have else None

    def length(self, name: str) -> Column:
        """A field's length in a document, for scores; null where it has none."""
        if self.mapping.fields[name].type == "text":
            return c(f"{name}__dl")
        return F.least(F.size(c(name)), F.lit(MAX_DL)) if self.multi else F.when(c(name).isNotNull(), 1)

    def totals(self) -> list[Column]:
        """Aggregates that :attr:`live` is made of."""
        names = [n for n in self.mapping.fields if self.held(n)]
        return [F.count(F.lit(1)).alias("n"), F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.sum(self.length(n)), F.lit(0)).cast("bigint"))]).alias("sums") if names else F.lit(None).alias("sums")]

    def raw(self, name: str) -> Column | None:
        """The first value of a field as its document gives it: what sorts, buckets and
        projections use. A ``.keyword`` companion reads its parent."""
        base = name.removesuffix(".keyword")
        for n in (f"{base}__raw", base):
            if n in self.columns:
                f = self.mapping.fields.get(base)
                return F.get(c(n), F.lit(0)) if self.multi and n == base and f is not None else c(n)
        return None


def text_columns(name: str, value: Column, f: FieldMapping) -> dict[str, Column]:
    terms, at = analyzer(f.analyzer).columns(value)
    out = {f"{name}__terms": terms}
    if at is not None:
        out[f"{name}__pos"] = at
    return out


def joined_texts(values: Column, f: FieldMapping) -> Column:
    """(terms, pos) of a text field: the values' terms one after another, positions
    ``ARRAY_GAP`` apart from value to value."""
    a = analyzer(f.analyzer)
    empty = F.struct(F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("pos"))

    def one(value: Column) -> Column:
        terms, at = a.columns(value)
        return F.struct(terms.alias("terms"), (F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>")) if at is None else at).alias("pos"))

    def add(acc: Column, value: Column) -> Column:
        new = one(value)
        base = F.when(F.size(acc["pos"]) > 0, F.array_max(acc["pos"]) + 1 + ARRAY_GAP).otherwise(0)
        return F.struct(F.concat(acc["terms"], new["terms"]).alias("terms"), F.concat(acc["pos"], F.transform(new["pos"], lambda p: p + base)).alias("pos"))

    return F.when(F.size(values) == 1, one(F.get(values, F.lit(0)))).otherwise(F.aggregate(values, empty, add))


def _with_lengths(df: DataFrame, mapping: Mapping) -> DataFrame:
    names = [n for n, f in mapping.fields.items() if f.type == "text" and f"{n}__terms" in df.columns]
    return df.withColumns({f"{n}__dl": F.least(F.size(c(f"{n}__terms")), F.lit(MAX_DL)) for n in names}) if names else df


def from_table(df: DataFrame, mapping: Mapping, ord_col: str, name: str = "index", doc_id: Column | None = None, values: dict[str, Column] | None = None) -> IndexFrame:
    """A typed table as an index: a scalar a field, the field's column unless ``values``
    gives another. ``ord_col`` is an expression of a unique, rising integer key."""
    out = {"doc_ord": F.expr(ord_col).cast("bigint"), "doc_id": F.expr(ord_col).cast("string") if doc_id is None else doc_id}
    for n, f in mapping.fields.items():
        value = (values or {}).get(n, df[n] if n in df.columns else None)
        if value is None:
            continue
        if f.type == "text":
            out |= text_columns(n, value, f) | {f"{n}__raw": value}
        elif f.type == "date":
            kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
            out[n] = iso_millis(value) if kind == "string" else millis(value.cast("timestamp"))
            out[f"{n}__raw"] = value
        elif f.type == "keyword" and f.ignore_above is not None:
            out[n] = F.when(F.length(value) <= f.ignore_above, value)
            out[f"{n}__raw"] = value
        else:
            out[n] = value.cast(SPARK_TYPES[f.type])
    got = df.select(*[x.alias(k) for k, x in out.items()])
    return IndexFrame(_with_lengths(got, mapping), mapping, name)


def _at_most(n: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x) <= n


def analyzed_json(docs: DataFrame, mapping: Mapping) -> DataFrame:
    """``docs`` (doc_ord, doc_id, source as JSON) with the columns of every mapped field. JSON
    is parsed once a document and a field's values are read once, in projections of their
    own, which the optimizer doesn't merge as their columns are used several times."""
    kinds: dict[tuple[str, str], str] = {}
    of: dict[str, str] = {}
    for n, f in mapping.fields.items():
        base = n.removesuffix(".keyword") if n.endswith(".keyword") and n.removesuffix(".keyword") in mapping.fields else n
        path = "$" + "".join(f'["{p}"]' for p in base.split("."))
        kind = {"date": "string", "text": "string"}.get(f.type, SPARK_TYPES.get(f.type, "string"))
        of[n] = kinds.setdefault((path, kind), f"__v{len(kinds)}")
    parsed = docs.select("*", F.parse_json("source").alias("__json"))
    given = parsed.select(
        *docs.columns,
        *[F.struct(F.try_variant_get("__json", path, f"array<{kind}>").alias("many"), F.try_variant_get("__json", path, kind).alias("one")).alias(v) for (path, kind), v in kinds.items()],
    )
    held = given.select(*docs.columns, *[F.filter(F.coalesce(c(v)["many"], F.when(c(v)["one"].isNotNull(), F.array(c(v)["one"]))), lambda x: x.isNotNull()).alias(v) for v in kinds.values()])
    texts = {n: f"__t{k}" for k, n in enumerate(n for n, f in mapping.fields.items() if f.type == "text" and f.index)}
    held = held.select("*", *[joined_texts(c(of[n]), mapping.fields[n]).alias(t) for n, t in texts.items()])
    out: dict[str, Column] = {}
    for n, f in mapping.fields.items():
        values = c(of[n])
        if f.type == "text":
            if f.index:
                out |= {f"{n}__terms": c(texts[n])["terms"], f"{n}__pos": c(texts[n])["pos"]}
            out[f"{n}__raw"] = F.get(values, F.lit(0))
            continue
        if f.type == "date":
            out[f"{n}__raw"] = F.get(values, F.lit(0))
            values = F.filter(F.transform(values, iso_millis), lambda x: x.isNotNull())
        elif f.type == "keyword" and f.ignore_above is not None:
            out[f"{n}__raw"] = F.get(values, F.lit(0))
            values = F.filter(values, _at_most(f.ignore_above))
        out[n] = F.when(F.size(values) > 0, values)
    got = held.select(*docs.columns, *[x.alias(k) for k, x in out.items()])
    return _with_lengths(got, mapping)
