"""WARC records found by boundary-chain verification.

A file is cut into byte ranges that tasks scan on their own. Each emits every place where
the record magic stands, with the record's successor (header end + Content-Length + 4).
Such a place may lie inside a payload, so a record counts only if the chain of successors
from the start of its file reaches it. The chain is followed in two levels: inside a range
each candidate is led to the first successor beyond the range; between ranges those exits
are composed with themselves (pointer jumping), so a file of n ranges takes log2(n) rounds
of joins, over the candidates that some chain enters a range at. Each range is then walked
from the entry that was reached, and only those records' payloads are read.

Files that begin as gzip (``.warc.gz``) are chained by members: a candidate is a gzip magic
whose member can be unpacked and holds whole records, its successor the byte after it. A
file that is one member is unpacked by one task, as a stream.

Defined cases: an empty file has no records; a candidate without an end of header within
``max_header`` bytes or a whole non-negative Content-Length, or whose payload the file cuts off, has no successor, and a chain
ends where its next record isn't a candidate: what follows isn't returned, and
:func:`read` tells for each file how far its chain came and whether that is its end. The
payload may hold any bytes. When writing, a null payload is written as an empty block, a
null id or URI as no field; line breaks in a URI are percent-encoded; repeated rows are
repeated records; extra columns are ignored, under any names; an empty table makes no
records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, plain, saved
from quarry.shared import scratch

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
END = b"\r\n\r\n"
RANGE_BYTES = 8 << 20
#: The longest header; bounds what a false magic may read on for.
MAX_HEADER = 64 << 10
#: Bytes read, unpacked and sent on at a time.
CHUNK = 1 << 18
BATCH_BYTES = 32 << 20


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """``pages`` as uncompressed WARC files below ``path``, a record a row, written by the
    text sink (and so with its commit protocol): the record separator is its line end."""
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))).otherwise(F.lit(""))
    pages, (i, u, p) = plain(pages, id_col, uri, payload)
    body = F.coalesce(F.col(p), F.lit(""))
    link = F.replace(F.replace(F.col(u), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/html\r\n"),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col(i).cast("string"), F.lit(">"))),
        field("WARC-Target-URI", link), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    pages.select(F.concat(head, body).alias("value")).write.option("lineSep", END.decode()).text(path)


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return where.open_input_file(path)


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _length(fields: dict[str, str]) -> int | None:
    given = fields.get("content-length", "")
    return int(given) if re.fullmatch(r"\d{1,15}", given) else None


Record = tuple[int, int, int, int, int, str | None, str | None]  # offset, inner, body, length, successor, id, URI


def scan_range(f, size: int, start: int, stop: int, max_header: int = MAX_HEADER) -> list[Record]:
    """The candidates that begin in [start, stop)."""
    f.seek(start)
    buf = f.read(min(size, stop + max_header) - start)
    found = []
    for m in MAGIC.finditer(buf):
        at = m.start()
        if start + at >= stop:
            break
        end = buf.find(END, at, at + max_header)
        if end < 0:
            continue
        fields = _fields(buf[at:end])
        length = _length(fields)
        body = start + end + len(END)
        if length is not None and body + length <= size:
            found.append((start + at, 0, body, length, body + length + len(END), fields.get("warc-record-id"), fields.get("warc-target-uri")))
    return found


def unpacked(f, at: int) -> Iterator[bytes | int]:
    """The member that begins at ``at``, in chunks, and then the offset of its end; that is
    missing where it can't be unpacked."""
    f.seek(at)
    z = zlib.decompressobj(31)
    try:
        while not z.eof:
            data = z.unconsumed_tail
            if not data:
                data = f.read(CHUNK)
                at += len(data)
                if not data:
                    return
            yield z.decompress(data, CHUNK)
    except zlib.error:
        return
    yield at - len(z.unused_data)


def member(f, at: int, max_header: int = MAX_HEADER) -> list[Record]:
    """The records of the gzip member at ``at``; none unless it holds whole ones."""
    out, buf, skip, place, end = [], b"", 0, 0, None
    for chunk in unpacked(f, at):
        if isinstance(chunk, int):
            end = chunk
            break
        buf += chunk
        while buf:
            if skip:  # payload and separator
                n = min(skip, len(buf))
                skip, place, buf = skip - n, place + n, buf[n:]
                continue
            stop = buf.find(END, 0, max_header)
            if stop < 0:
                if len(buf) >= max_header:
                    return []
                break
            fields = _fields(buf[:stop])
            length = _length(fields)
            if not MAGIC.match(buf) or length is None:
                return []
            place, buf = place + stop + len(END), buf[stop + len(END) :]
            out.append((at, len(out), place, length, -1, fields.get("warc-record-id"), fields.get("warc-target-uri")))
            skip = length + len(END)
    # the last separator may be missing
    return [(*r[:4], end, *r[5:]) for r in out] if end is not None and not buf and skip in (0, len(END)) else []


def scan_members(f, size: int, start: int, stop: int, max_header: int = MAX_HEADER) -> list[Record]:
    f.seek(start)
    buf = f.read(min(size, stop + 4) - start)
    return [r for m in GZIP.finditer(buf) if start + m.start() < stop for r in member(f, start + m.start(), max_header)]


def _exits(offsets: np.ndarray, successors: np.ndarray, stop: int) -> np.ndarray:
    """The first successor at or beyond ``stop`` on each candidate's chain; -1 where it breaks."""
    exits = successors.copy()
    at = {o: k for k, o in enumerate(offsets.tolist())}
    for k in range(len(offsets) - 1, -1, -1):
        if successors[k] < stop:
            nxt = at.get(int(successors[k]))
            exits[k] = exits[nxt] if nxt is not None else -1
    return exits


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size, start, stop) of every range of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
    return cut.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))


CANDIDATES = "file string, start long, offset long, inner int, body long, length long, successor long, exit long, record string, uri string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in CANDIDATES.split(", ")]


def _candidates(max_header: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"]) as f:
                    packed = GZIP.match(f.read(4)) is not None
                    got = (scan_members if packed else scan_range)(f, row["size"], row["start"], row["stop"], max_header)
                heads = [r for r in got if r[1] == 0]
                exits = dict(zip([r[0] for r in heads], _exits(np.array([r[0] for r in heads], dtype=np.int64), np.array([r[4] for r in heads], dtype=np.int64), row["stop"]).tolist()))
                rows = [(row["file"], row["start"], *r[:5], exits[r[0]], *r[5:]) for r in got]
                columns = zip(*rows) if rows else [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], _NAMES)

    return run


def entries(found: DataFrame) -> DataFrame:
    """(file, offset): where the chain from the start of each file enters a range."""
    heads = found.where("inner = 0").select("file", F.col("offset").alias("a"), F.col("exit").alias("b"))
    # chains meet: a range has few candidates that one from another range leads to
    doors = heads.where("b >= 0").select("file", F.col("b").alias("a")).distinct()
    jump = saved(heads.where("a = 0").unionByName(heads.where("a > 0").join(doors, ["file", "a"], "left_semi")), "jumps")
    reached = saved(jump.where("a = 0").select("file", "a"), "reached")
    while True:
        ahead = reached.join(jump, ["file", "a"]).select("file", F.col("b").alias("a"))
        ahead = ahead.join(jump.select("file", "a"), ["file", "a"], "left_semi")
        new = saved(reached.unionByName(ahead).distinct(), "reached")
        if new.count() == reached.count():
            discard(reached, jump)
            return new.select("file", F.col("a").alias("offset"))
        discard(reached)
        reached = new
        further = jump.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
        on = saved(jump.join(further, ["file", "b"]).select("file", "a", F.col("c").alias("b")).unionByName(jump.join(further, ["file", "b"], "left_anti").select("file", "a", F.lit(-1).cast("long").alias("b"))), "jumps")
        discard(jump)
        jump = on


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    nxt = dict(zip(pdf["offset"], pdf["successor"]))
    on: set[int] = set()
    for at in pdf.loc[pdf["entry"], "offset"]:
        while at in nxt and at not in on:
            on.add(at)
            at = nxt[at]
    return pdf[pdf["offset"].isin(on)].sort_values(["offset", "inner"])[list(TRUE_NAMES)]


TRUE = "file string, offset long, inner int, body long, length long, successor long, record string, uri string"
TRUE_NAMES = tuple(x.split()[0] for x in TRUE.split(", "))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the payloads of true records; one member's records lie side by side."""
    held: list[tuple] = []
    name, f, stream = None, None, None

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], ["file", "offset", "inner", "record", "uri", "length", "payload"])

    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != name:
                if f is not None:
                    f.close()
                name, f, stream = r["file"], _open(r["file"]), None
                packed = GZIP.match(f.read(4)) is not None
            if packed:
                if stream is None or stream[0] != r["offset"] or stream[2] > r["body"]:
                    stream = [r["offset"], unpacked(f, r["offset"]), 0, b""]
                got = bytearray()
                while stream[2] < r["body"] + r["length"]:
                    if not stream[3]:
                        stream[3] = next(stream[1])
                        continue
                    skip = max(0, min(len(stream[3]), r["body"] - stream[2]))
                    take = stream[3][skip : skip + r["length"] - len(got)]
                    got += take
                    stream[2] += skip + len(take)
                    stream[3] = stream[3][skip + len(take) :]
                payload = bytes(got)
            else:
                f.seek(r["body"])
                payload = f.read(r["length"])
            held.append((r["file"], r["offset"], r["inner"], r["record"], r["uri"], r["length"], payload))
            size += len(payload)
            if size > BATCH_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()
    if f is not None:
        f.close()


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, max_header: int = MAX_HEADER) -> tuple[DataFrame, DataFrame]:
    """(records, files) below ``path``: records as (file, offset, inner, record, uri, length,
    payload), inner being the place in a gzip member; files as (file, size, records,
    verified_bytes, complete), complete where the chain ends at the end of the file."""
    cut = saved(ranges(spark, path, range_bytes), "ranges")
    found = saved(cut.repartition("file", "start").mapInArrow(_candidates(max_header), CANDIDATES), "candidates")
    entry = entries(found).withColumn("entry", F.lit(True))
    marked = found.join(entry, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    true = saved(marked.groupBy("file", "start").applyInPandas(_walk, TRUE), "true")
    came = true.groupBy("file").agg(F.count("*").alias("records"), F.max("successor").alias("upto"))
    whole = cut.select("file", "size").distinct().join(came, "file", "left")
    upto = F.least(F.coalesce("upto", F.lit(0)), "size")
    files = whole.select("file", "size", F.coalesce("records", F.lit(0)).alias("records"), upto.alias("verified_bytes"), (F.coalesce("upto", F.lit(0)) >= F.col("size")).alias("complete"))
    return true.mapInArrow(_payloads, "file string, offset long, inner int, record string, uri string, length long, payload binary"), files


def records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, max_header: int = MAX_HEADER) -> DataFrame:
    """The true records below ``path``; see :func:`read`."""
    return read(spark, path, range_bytes, max_header)[0]


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, length, payload_md5) of ``pages``, written as WARC and read again."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    got = records(pages.sparkSession, path)
    return got.select(F.regexp_extract("record", r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint").alias("page_id"), F.col("uri").alias("url"), "length", F.md5("payload").alias("payload_md5"))


SQL = """
SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS length,
  md5(coalesce(html, '')) AS payload_md5 FROM pages
"""
