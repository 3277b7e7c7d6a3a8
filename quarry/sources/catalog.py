"""A catalog of indices: immutable Parquet commits behind a manifest.

    <root>/<index>/manifest-N.json     version N: mapping, commits, retired ordinals, counts
    <root>/<index>/docs/<commit>/      analyzed documents
    <root>/<index>/postings/<commit>/  their terms, sorted
    <root>/<index>/retired/<commit>/   ordinals that an upsert or a delete took away

Writers put files down first and publish them with a new manifest, which holds all that
makes up a version, so a reader sees whole versions only and a failed write leaves nothing
visible. One writer an index is assumed; of two that publish the same version one fails.
The small JSON files go through Hadoop's file system, like the Parquet.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import IndexAlreadyExistsError, IndexNotFoundError, InvalidQueryError, MappingError
from quarry.mapping import DYNAMIC_IGNORE_ABOVE, FieldMapping, Mapping, infer, merge, parse_mapping, validate
from quarry.operators import postings
from quarry.operators.frame import IndexFrame, analyzed_json, c
from quarry.shared import spread

SCHEMA = "doc_ord bigint, doc_id string, source string"
EMPTY = {"mapping": {}, "commits": [], "retired": [], "next_ord": 0, "batches": {}, "total": 0, "live": {"n": 0, "sums": {}}}
#: Bits of monotonically_increasing_id that count rows within a task.
ROW_BITS = 33


class Files:
    """Small text files on any Hadoop file system."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file, whole or not at all: written aside, then renamed."""
        fs, p = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(aside, p):
            fs.delete(aside, False)
            raise OSError(f"{path} could not be published: it exists")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def drop(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, index: str, *parts: str) -> str:
        return "/".join([self.root, index, *parts])

    # lifecycle

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self._versions(n)]

    def _versions(self, index: str) -> list[int]:
        return [int(m[1]) for n in self.files.names(self._path(index)) if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]

    def exists(self, index: str) -> bool:
        return bool(self._versions(index))

    def create(self, index: str, mapping: dict[str, Any] | None = None) -> Mapping:
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", index):
            raise InvalidQueryError(f"{index!r} is no index name")
        if self.exists(index):
            raise IndexAlreadyExistsError(f"index {index!r} exists")
        made = parse_mapping(mapping)
        self._publish(index, EMPTY | {"mapping": made.to_dict()}, 0)
        return made

    def delete(self, index: str) -> None:
        if not self.exists(index):
            raise IndexNotFoundError(f"there is no index {index!r}")
        self.files.drop(self._path(index))

    def mapping(self, index: str) -> Mapping:
        return Mapping.from_dict(self.manifest(index)["mapping"])

    def update_mapping(self, index: str, body: dict[str, Any]) -> Mapping:
        """Adds fields; a field's type stays."""
        m = self.manifest(index)
        made = merge(Mapping.from_dict(m["mapping"]), parse_mapping(body))
        self._publish(index, m | {"mapping": made.to_dict()}, m["version"] + 1)
        return made

    # versions

    def manifest(self, index: str) -> dict[str, Any]:
        versions = self._versions(index)
        if not versions:
            raise IndexNotFoundError(f"there is no index {index!r}")
        return json.loads(self.files.read(self._path(index, f"manifest-{max(versions)}.json"))) | {"version": max(versions)}

    def _publish(self, index: str, manifest: dict[str, Any], version: int) -> None:
        self.files.write(self._path(index, f"manifest-{version}.json"), json.dumps({k: manifest[k] for k in EMPTY}))

    def _stored(self, index: str, m: dict[str, Any]) -> DataFrame:
        if not m["commits"]:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.option("mergeSchema", "true").parquet(*[self._path(index, "docs", x) for x in m["commits"]])

    def _retired(self, index: str, m: dict[str, Any]) -> DataFrame | None:
        paths = [self._path(index, "retired", x) for x in m["retired"]]
        return self.spark.read.schema("doc_ord bigint").parquet(*paths) if paths else None

    def live(self, index: str, m: dict[str, Any] | None = None) -> DataFrame:
        m = m or self.manifest(index)
        docs, gone = self._stored(index, m), self._retired(index, m)
        return docs if gone is None else docs.join(gone, "doc_ord", "left_anti")

    def frame(self, index: str) -> IndexFrame:
        m = self.manifest(index)
        posted = None
        if m["commits"]:
            posted, gone = self.spark.read.schema(postings.SCHEMA).parquet(*[self._path(index, "postings", x) for x in m["commits"]]), self._retired(index, m)
            posted = posted if gone is None else posted.join(gone, "doc_ord", "left_anti")
        return IndexFrame(self.live(index, m), Mapping.from_dict(m["mapping"]), index, multi=True, postings=posted, live=m["live"], commits=len(m["commits"]))

    # writes

    def put(self, index: str, docs: list[dict[str, Any]], ids: list[str | None] | None = None) -> list[str]:
        """Index documents given on the driver; of one id's, the last stands. All of them
        are validated before anything is written."""
        m = self.manifest(index)
        mapping = infer(Mapping.from_dict(m["mapping"]), docs)
        for doc in docs:
            validate(mapping, doc)
        keys = [k or uuid.uuid4().hex for k in (ids or [None] * len(docs))]
        last = {k: (i, d) for i, (k, d) in enumerate(zip(keys, docs))}
        rows = [(i, k, json.dumps(d, ensure_ascii=False)) for k, (i, d) in last.items()]
        self._append(index, m, self.spark.createDataFrame(rows, SCHEMA), mapping)
        return keys

    def put_frame(self, index: str, docs: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Index a DataFrame (doc_id, source as JSON) in the order of its rows; null ids get
        one, of one id's rows the last stands. The mapping grows by the merged schema of the
        sources; where that doesn't agree with the mapping nothing is written and
        MappingError is raised, as :meth:`put` does. ``batch`` (stream, number) makes the
        write idempotent; whether it was done is returned."""
        m = self.manifest(index)
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return False
        path = self._path(index, "staged", uuid.uuid4().hex)
        try:
            kept = docs.where("source is not null").select(F.coalesce("doc_id", F.expr("replace(uuid(), '-', '')")).alias("doc_id"), "source", F.monotonically_increasing_id().alias("row"))
            spread(kept).write.parquet(path)  # rows keep their numbers
            staged = self.spark.read.schema("doc_id string, source string, row bigint").parquet(path)
            task = F.shiftright("row", ROW_BITS)
            tasks = staged.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg(F.parse_json("source")).alias("shape")).collect()
            shapes = sorted({r["shape"] for r in tasks})
            mapping = Mapping.from_dict(m["mapping"])
            for shape in shapes:
                mapping = _grown(mapping, shape)
            starts, rows = {}, 0
            for r in sorted(tasks, key=lambda r: r["task"]):
                starts[r["task"]] = rows - (r["task"] << ROW_BITS)
                rows += r["n"]
            # dense ordinals in the order of rows: each task's rows follow those before
            base = F.broadcast(self.spark.createDataFrame(sorted(starts.items()), "task bigint, start bigint"))  # a row a task
            last = staged.groupBy("doc_id").agg(F.max_by("source", "row").alias("source"), F.max("row").alias("row"))
            last = last.withColumn("task", F.shiftright("row", ROW_BITS)).join(base, "task").withColumn("doc_ord", F.col("row") + F.col("start"))
            self._append(index, m, last.select("doc_ord", "doc_id", "source"), mapping, batch)
        finally:
            self.files.drop(path)
        return True

    def _append(self, index: str, m: dict[str, Any], rows: DataFrame, mapping: Mapping, batch: tuple[str, int] | None = None) -> None:
        """``rows``' doc_ord only order them; new ordinals follow the ones in use."""
        mapping = merge(Mapping.from_dict(m["mapping"]), mapping)
        name = f"{m['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        based = rows.withColumn("doc_ord", F.col("doc_ord") + F.lit(m["next_ord"]))
        try:
            new, found = self._write(index, name, based, mapping)
            for f, bad in (found["bad"] or {}).items():
                if bad:
                    raise MappingError(f"field {f!r} of type {mapping.fields[f].type!r} can't hold {bad} of the values")
            retired, gone = self._retire(index, m, new.select("doc_id"), name)
        except BaseException:
            self._unwrite(index, name)
            raise
        live = {"n": m["live"]["n"] + found["n"] - gone["n"], "sums": _added(m["live"]["sums"], found["sums"], gone["sums"])}
        batches = m["batches"] | ({batch[0]: batch[1]} if batch else {})
        top = m["next_ord"] if found["top"] is None else found["top"] + 1
        self._publish(index, {"mapping": mapping.to_dict(), "commits": [*m["commits"], name], "retired": [*m["retired"], *retired], "next_ord": top, "batches": batches, "total": m["total"] + found["n"], "live": live}, m["version"] + 1)

    def _write(self, index: str, name: str, rows: DataFrame, mapping: Mapping) -> tuple[DataFrame, Any]:
        """A commit's documents and postings; the documents, and their totals."""
        analyzed_json(rows, mapping).write.parquet(self._path(index, "docs", name))
        new = self.spark.read.parquet(self._path(index, "docs", name))
        frame = IndexFrame(new, mapping, index, multi=True)
        # a time that can't be read is the one conflict that types don't show
        dates = [f for f, x in mapping.fields.items() if x.type == "date" and x.index and f"{f}__raw" in new.columns]
        bad = F.create_map(*[x for f in dates for x in (F.lit(f), F.count_if(c(f"{f}__raw").isNotNull() & c(f).isNull()))]) if dates else F.lit(None)
        found = new.agg(*frame.totals(), F.max("doc_ord").alias("top"), bad.alias("bad")).first()
        if found["n"]:
            postings.write(postings.build(frame), self._path(index, "postings", name))
        else:
            self.spark.createDataFrame([], postings.SCHEMA).write.parquet(self._path(index, "postings", name))
        return new, found

    def _unwrite(self, index: str, name: str) -> None:
        for kind in ("docs", "postings", "retired"):
            self.files.drop(self._path(index, kind, name))

    def _retire(self, index: str, m: dict[str, Any], ids: DataFrame, name: str) -> tuple[list[str], dict[str, Any]]:
        """The retired part that the live documents of ``ids`` make up, and their totals."""
        none = {"n": 0, "sums": {}}
        if not m["commits"]:
            return [], none
        old = IndexFrame(self.live(index, m).join(ids, "doc_id", "left_semi"), Mapping.from_dict(m["mapping"]), index, multi=True)
        lengths = {f: f"n{k}" for k, f in enumerate(f for f in old.mapping.fields if old.held(f))}
        path = self._path(index, "retired", name)
        old.df.select("doc_ord", *[F.coalesce(old.length(f), F.lit(0)).cast("bigint").alias(n) for f, n in lengths.items()]).write.parquet(path)
        got = self.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in lengths.values()]).first()
        if not got["n"]:
            self.files.drop(path)
            return [], none
        return [name], {"n": got["n"], "sums": {f: got[n] for f, n in lengths.items()}}

    def remove(self, index: str, ids: list[str]) -> bool:
        """Whether any of ``ids`` was live."""
        m = self.manifest(index)
        name = f"{m['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        retired, gone = self._retire(index, m, self.spark.createDataFrame([(i,) for i in ids], "doc_id string"), name)
        if retired:
            live = {"n": m["live"]["n"] - gone["n"], "sums": _added(m["live"]["sums"], {}, gone["sums"])}
            self._publish(index, m | {"retired": [*m["retired"], *retired], "live": live}, m["version"] + 1)
        return bool(retired)

    def forget(self, index: str, stream: str) -> None:
        """Drops what is known of a stream's batches."""
        m = self.manifest(index)
        if stream in m["batches"]:
            self._publish(index, m | {"batches": {k: v for k, v in m["batches"].items() if k != stream}}, m["version"] + 1)

    def get(self, index: str, doc_id: str) -> dict[str, Any] | None:
        row = self.live(index).where(F.col("doc_id") == doc_id).select("source").first()
        return json.loads(row["source"]) if row else None

    def compact(self, index: str) -> None:
        """One commit of the live documents in order; ordinals stay."""
        m = self.manifest(index)
        if len(m["commits"]) <= 1 and not m["retired"]:
            return
        name = f"{m['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows = self.live(index, m).select("doc_ord", "doc_id", "source").repartitionByRange("doc_ord").sortWithinPartitions("doc_ord")
        _, found = self._write(index, name, rows, Mapping.from_dict(m["mapping"]))
        self._publish(index, m | {"commits": [name], "retired": [], "total": found["n"], "live": {"n": found["n"], "sums": found["sums"] or {}}}, m["version"] + 1)

    def stats(self, index: str) -> dict[str, int]:
        m = self.manifest(index)
        return {"doc_count": m["total"], "deleted_count": m["total"] - m["live"]["n"], "live_count": m["live"]["n"], "segment_count": len(m["commits"]), "next_ord": m["next_ord"], "version": m["version"]}


def _added(sums: dict[str, int], more: dict[str, int] | None, less: dict[str, int]) -> dict[str, int]:
    more = more or {}
    return {f: sums.get(f, 0) + more.get(f, 0) - less.get(f, 0) for f in {**sums, **more}}


KINDS = {"BIGINT": "long", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "text", "FLOAT": "double"}


#: Variant types whose values a field of a type holds.
FITS = {"text": r".*", "keyword": "STRING", "date": "STRING", "boolean": "BOOLEAN", "long": "BIGINT", "double": r"BIGINT|DOUBLE|FLOAT|DECIMAL.*"}


def _grown(mapping: Mapping, shape: str) -> Mapping:
    """``mapping`` with the leaves of a variant schema. Types that documents disagree on
    are mapped as text; leaves that are mapped must fit."""
    found = dict(mapping.fields)

    def visit(node: str, path: str) -> None:
        node = node.strip()
        if node.startswith("OBJECT<") and node.endswith(">"):
            for name, inner in _members(node[7:-1]):
                visit(inner, f"{path}.{name}" if path else name)
            return
        if node.startswith("ARRAY<"):
            node = node[6:-1].strip()
            if node.startswith("OBJECT<"):
                return
        if not path or node in ("VOID", "NULL"):
            return
        if path in found:
            f = found[path]
            if f.index and not re.fullmatch(FITS[f.type], node):
                raise MappingError(f"field {path!r} of type {f.type!r} can't hold {node.lower()}")
            return
        kind = "double" if node.startswith("DECIMAL") else KINDS.get(node, "text")
        found[path] = FieldMapping(kind)
        if kind == "text":
            found.setdefault(f"{path}.keyword", FieldMapping("keyword", ignore_above=DYNAMIC_IGNORE_ABOVE))

    if not shape.startswith("OBJECT") and shape not in ("VOID", "NULL"):
        raise MappingError("documents must be JSON objects")
    visit(shape, "")
    return Mapping(found)


def _members(body: str) -> list[tuple[str, str]]:
    """``name: TYPE, ...`` at the outermost level; names may stand in backticks."""
    out, at = [], 0
    while at < len(body):
        m = re.compile(r"\s*(?:`((?:[^`]|``)*)`|([^:`]+?))\s*:").match(body, at)
        if m is None:
            raise MappingError(f"the schema of the documents can't be read near {body[at : at + 40]!r}")
        depth, end = 0, m.end()
        while end < len(body) and (depth or body[end] != ","):
            depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(body[end], 0)
            end += 1
        out.append(((m[1] or m[2]).replace("``", "`"), body[m.end() : end]))
        at = end + 1
    return out
