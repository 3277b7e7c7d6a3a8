"""Log files as lines or multi-line records with exact byte offsets, and document ids.

Files are cut into byte ranges; a task reads the lines (or records) that begin in its range,
so one large file is read by many tasks and nothing is shuffled."""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 4096
MAX_LINE_BYTES = 1 << 20
RANGE_BYTES = 8 << 20
#: Records sent on at a time, and bytes of their text.
BATCH, BATCH_BYTES = 10_000, 16 << 20

SCHEMA = "file string, origin string, offset bigint, end_offset bigint, message string, truncated boolean, line_count int"


def open_file(uri: str) -> tuple[BinaryIO, int]:
    """A buffered file and its size, wherever Arrow's file systems reach."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.\-]+:/", uri):
        where, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    else:
        where, path = fs.LocalFileSystem(), uri
    return io.BufferedReader(where.open_input_file(path), 1 << 18), where.get_file_info(path).size


def local_path(uri: str) -> str | None:
    return re.sub(r"^file:/+", "/", uri) if re.match(r"file:/|/", uri) or ":" not in uri else None


def signature(path: str) -> str:
    """Of a local file: device, inode and a digest of the first bytes once there are enough."""
    st = os.stat(path)
    with open(path, "rb") as f:
        head = f.read(HEAD)
    return f"{st.st_dev}:{st.st_ino}:{hashlib.sha1(head).hexdigest() if len(head) == HEAD else 'short'}"


def origin(uri: str, f: BinaryIO) -> str:
    """What a file's ids are made of: device and inode (elsewhere the name) and a digest of
    the first line. A renamed file keeps it, one that grows too; one cut and written anew
    doesn't."""
    f.seek(0)
    first = hashlib.sha1(f.readline(HEAD)).hexdigest()
    path = local_path(uri)
    st = os.stat(path) if path is not None else None
    return f"{st.st_dev}:{st.st_ino}:{first}" if st else f"{uri}:{first}"


def lines_between(f: BinaryIO, start: int, stop: int, most: int = MAX_LINE_BYTES) -> Iterator[tuple[int, int, str, bool]]:
    """(offset, end, text, truncated) of the lines that begin in [start, stop). At most
    ``most`` bytes of a line are kept, the rest is passed over; bytes that aren't UTF-8 become
    U+FFFD and don't shift offsets. A carriage return before the line end is dropped, and the
    last line needs no end."""
    at = start
    f.seek(max(0, start - 1))
    if start and f.read(1) != b"\n":
        while part := f.readline(1 << 16):
            at += len(part)
            if part.endswith(b"\n"):
                break
    while at < stop:
        part = f.readline(most + 2)
        if not part:
            return
        end, body = at + len(part), part
        if part.endswith(b"\n"):
            body = part[:-1].removesuffix(b"\r")
        elif len(part) == most + 2:
            while rest := f.readline(1 << 16):
                end += len(rest)
                if rest.endswith(b"\n"):
                    break
        yield at, end, body[:most].decode("utf-8", "replace"), len(body) > most
        at = end


def records_between(f: BinaryIO, start: int, stop: int, most: int = MAX_LINE_BYTES, opens: str | None = None, until: int | None = None) -> Iterator[tuple[int, int, str, bool, int]]:
    """(offset, end, text, truncated, lines) of the records that begin in [start, stop):
    lines, or where ``opens`` is given, what begins at a line that it matches at its start
    (or at byte 0) and takes in the lines after it, joined by line breaks; these may lie
    beyond ``stop``, but not beyond ``until``. At most ``most`` bytes of text are kept."""
    if opens is None:
        for at, end, text, cut in lines_between(f, start, stop, most):
            yield at, end, text, cut, 1
        return
    rule = re.compile(opens)
    held: list | None = None
    for at, end, text, cut in lines_between(f, start, until if until is not None else 1 << 62, most):
        if rule.match(text) or at == 0:
            if held is not None:
                yield held[0], held[1], "\n".join(held[2]), held[3], held[4]
            if at >= stop:
                return
            held = [at, end, [text], cut, 1, len(text)]
        elif held is not None:
            held[1], held[3], held[4] = end, held[3] or cut, held[4] + 1
            if held[5] + 1 + len(text) <= most:
                held[2].append(text)
                held[5] += 1 + len(text)
            else:
                held[3] = True
        elif at >= stop:
            return
    if held is not None:
        yield held[0], held[1], "\n".join(held[2]), held[3], held[4]


KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def read_lines(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES, opens: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, origin, offset, end_offset, message, truncated, line_count) of every line of the
    files at ``path``, or of every record that ``opens`` begins."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f, _ = open_file(r["file"])
                with f:
                    who, held, size = origin(r["file"], f), [], 0
                    for record in records_between(f, r["start"], min(r["start"] + range_bytes, r["length"]), max_line_bytes, opens, r["length"]):
                        held.append((r["file"], who, *record))
                        size += len(record[2])
                        if len(held) >= BATCH or size > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], NAMES)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], NAMES)

    # tasks in the order of files and offsets, so that rows are numbered in the order of input
    return ranges.repartitionByRange("file", "start").sortWithinPartitions("file", "start").mapInArrow(run, SCHEMA)


def doc_id(mode: str, text: Column, where: Column | None = None, offset: Column | None = None) -> Column:
    """``offset``: origin of the file and byte, the same over replays, renames and ways of
    reading; ``content``: a digest of the text; ``uuid``: random."""
    if mode == "content":
        return F.substring(F.sha2(text, 256), 1, 20)
    if mode == "offset":
        return F.concat_ws(":", F.substring(F.sha2(where, 256), 1, 12), offset.cast("string"))
    return F.expr("replace(uuid(), '-', '')")
