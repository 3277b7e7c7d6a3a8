"""Ranking, sorting, paging, projection, buckets and the response of a search."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.analysis import python_float
from quarry.operators.frame import IndexFrame
from quarry.operators.score import Scorer
from quarry.plans.ast import Search, Sort, TermsAgg, to_dict


def by_relevance(sort: tuple[Sort, ...]) -> bool:
    return not sort or (len(sort) == 1 and sort[0].field == "_score" and sort[0].descending)


def sort_keys(index: IndexFrame, sort: tuple[Sort, ...]) -> list[tuple[str, Column, bool]]:
    """(name, value, whether falling) of each key of a field sort that the index has."""
    if by_relevance(sort):
        return []
    values = [(F.col("score") if s.field == "_score" else index.raw(s.field), s.descending) for s in sort]
    return [(f"__k{k}", v, down) for k, (v, down) in enumerate(values) if v is not None]


def order_of(index: IndexFrame, sort: tuple[Sort, ...]) -> list[Column]:
    """Sort keys: missing values last either way, full ties by doc_ord."""
    if by_relevance(sort):
        return [F.desc("score"), F.asc("doc_ord")]
    return [*[v.desc_nulls_last() if down else v.asc_nulls_last() for _, v, down in sort_keys(index, sort)], F.asc("doc_ord")]


def page(index: IndexFrame, found: DataFrame, sort: tuple[Sort, ...] = (), from_: int = 0, size: int = 10, cap: int | None = None) -> DataFrame:
    """One page of matches. ``cap`` lets a field sort see only that many matches, the first
    by doc_ord; without it the sort is exact."""
    if cap is not None and not by_relevance(sort):
        found = found.orderBy("doc_ord").limit(cap)
    ordered = found.orderBy(*order_of(index, sort))
    return (ordered.offset(from_) if from_ else ordered).limit(size)


def bucket_key(index: IndexFrame, field: str) -> Column:
    """The field's first value as text, written as Python's str() would."""
    value = index.raw(field)
    if value is None:
        return F.lit(None).cast("string")
    f = index.mapping.fields.get(field.removesuffix(".keyword"))
    kind = f.type if f is not None else "keyword"
    return F.initcap(value.cast("string")) if kind == "boolean" else python_float(value) if kind == "double" else value.cast("string")


def bucket_counts(index: IndexFrame, found: DataFrame, field: str) -> DataFrame:
    return found.select(bucket_key(index, field).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))


def terms_buckets(index: IndexFrame, found: DataFrame, agg: TermsAgg) -> DataFrame:
    """(key, doc_count): the largest buckets, ties by key."""
    return bucket_counts(index, found, agg.field).orderBy(F.desc("doc_count"), F.asc("key")).limit(agg.size)


def project(index: IndexFrame, found: DataFrame, fields: tuple[str, ...], *keep: str) -> DataFrame:
    """``keep`` columns and the first value of each of ``fields``, null where missing."""
    return found.select(*keep, *[(v if (v := index.raw(f)) is not None else F.lit(None).cast("string")).alias(f) for f in fields])


def extract(doc: Any, field: str) -> Any:
    for part in field.removesuffix(".keyword").split("."):
        if not isinstance(doc, dict) or part not in doc:
            return None
        doc = doc[part]
    return (doc[0] if doc else None) if isinstance(doc, list) else doc


def project_source(doc: dict[str, Any], source: bool | tuple[str, ...]) -> dict[str, Any] | None:
    if isinstance(source, bool):
        return doc if source else None
    out: dict[str, Any] = {}
    for path in source:
        value = extract(doc, path)
        if value is None:
            continue
        *parents, last = path.split(".")
        node = out
        for p in parents:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[last] = value
    return out


def _sources(index: IndexFrame, ords: list[int]) -> dict[int, str]:
    """The documents of a page, as JSON."""
    rows = index.df.where(F.col("doc_ord").isin(ords)) if len(ords) <= 1000 else index.df.join(F.broadcast(index.df.sparkSession.createDataFrame([(x,) for x in ords], "doc_ord bigint")), "doc_ord")
    if "source" in index.columns and "source" not in index.mapping.fields:
        body = F.col("source")
    else:
        values = {n: index.raw(n) for n in index.mapping.fields if not n.endswith(".keyword")}
        body = F.to_json(F.struct(*[v.alias(n) for n, v in values.items() if v is not None]))
    return {r["doc_ord"]: r["body"] for r in rows.select("doc_ord", body.alias("body")).collect()}


def search(index: IndexFrame, request: Search, cap: int | None = None) -> dict[str, Any]:
    """The response envelope. Matches are found once: their ordinals, scores, sort and bucket
    keys are kept for the total, the page and the buckets; the page's documents are then
    fetched by ordinal."""
    began = time.perf_counter()
    found = Scorer(index).matches(request.query)
    keys = sort_keys(index, request.sort)
    buckets = {name: f"__b{k}" for k, (name, _) in enumerate(request.aggs)}
    kept = found.select("doc_ord", "doc_id", "score", *[c.alias(n) for n, c, _ in keys], *[bucket_key(index, agg.field).alias(buckets[name]) for name, agg in request.aggs]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = kept.agg(F.count(F.lit(1)), *[F.count(b) for b in buckets.values()]).first()
        total = counts[0]
        rows = []
        if request.size and total:
            some = kept.orderBy("doc_ord").limit(cap) if cap is not None and not by_relevance(request.sort) else kept
            order = [F.desc("score"), F.asc("doc_ord")] if by_relevance(request.sort) else [*[F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, _, down in keys], F.asc("doc_ord")]
            ordered = some.orderBy(*order)
            rows = (ordered.offset(request.from_) if request.from_ else ordered).limit(request.size).select("doc_ord", "doc_id", "score").collect()
        aggs = {}
        for k, (name, agg) in enumerate(request.aggs, 1):
            b = F.col(buckets[name])
            top = kept.where(b.isNotNull()).groupBy(b.alias("key")).agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.desc("doc_count"), F.asc("key")).limit(agg.size).collect()
            aggs[name] = {"doc_count_error_upper_bound": 0, "sum_other_doc_count": counts[k] - sum(r["doc_count"] for r in top), "buckets": [r.asDict() for r in top]}
    finally:
        kept.unpersist()
    bodies = _sources(index, [r["doc_ord"] for r in rows]) if rows and request.source is not False else {}
    hits = []
    for row in rows:
        hit = {"_index": index.name, "_id": row["doc_id"], "_score": row["score"]}
        got = project_source(json.loads(bodies[row["doc_ord"]]), request.source) if bodies else None
        hits.append(hit | ({"_source": got} if got is not None else {}))
    took = (time.perf_counter() - began) * 1000
    block: dict[str, Any] = {"query": to_dict(request.query), "segments_touched": index.commits, "took_ms": round(took, 3)}
    if not by_relevance(request.sort):
        block["sort_truncated"] = cap is not None and total > cap
        if block["sort_truncated"]:
            block["max_sort_candidates"] = cap
    out = {
        "took": round(took), "timed_out": False,
        "hits": {"total": {"value": total, "relation": "eq"}, "max_score": max((h["_score"] for h in hits), default=None), "hits": hits},
        "engine": block,
    }
    if request.aggs:
        out["aggregations"] = aggs
    return out
