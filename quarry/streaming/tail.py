"""Files that grow as a streaming source: whole lines are delivered once, by byte ranges.

The offset of the stream is {"device:inode": {"path": ..., "sig": ..., "at": byte}}, so a
file keeps its place when it is renamed. A file that rotation has moved out of the pattern
is looked for by its inode beside where it was, and read to its end; what then has its name
is another file and starts at 0. One that shrank, or whose first bytes changed, was written
anew and starts at 0 too. A micro-batch takes at most ``max_bytes`` (but a whole line, or
record). With ``multiline`` lines are put together to records, and the last record of a
file waits until the next one begins, or for the end of a stream that runs ``once``.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.errors import IngestError
from quarry.sources.catalog import Catalog
from quarry.sources.lines import MAX_LINE_BYTES, RANGE_BYTES, doc_id, lines_between, open_file, origin, records_between, signature
from quarry.streaming.processors import Processor, process

SCHEMA = "file string, origin string, offset bigint, end_offset bigint, message string, truncated boolean, line_count int"
#: How far back the beginning of an unfinished record is looked for.
LOOK_BACK = 16 << 20


def classify(old_sig: str | None, extent: int, sig: str, size: int) -> str:
    """fresh, rotated, truncated or unchanged. A file that had fewer bytes than a signature
    digests may grow into one; its inode then tells."""
    if old_sig is None:
        return "fresh"
    grown = old_sig.endswith(":short") and old_sig.rsplit(":", 1)[0] == sig.rsplit(":", 1)[0]
    if old_sig != sig and not grown:
        return "rotated"
    return "truncated" if size < extent else "unchanged"


def decide(saved: tuple[str, int] | None, sig: str, size: int, mode: str = "checkpoint") -> tuple[int, str]:
    """(offset to start at, why)."""
    if mode == "start":
        return 0, "start"
    if mode == "end":
        return size, "end"
    if mode != "checkpoint":
        raise IngestError(f"no such starting point: {mode!r}")
    if saved is None:
        return 0, "fresh"
    change = classify(saved[0], saved[1], sig, size)
    return (saved[1], "resume") if change == "unchanged" else (0, f"restart_{change}")


def whole_lines(path: str, size: int) -> int:
    """The end of the last finished line within the first ``size`` bytes."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            step = min(1 << 16, at)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return 0


#: Bytes of a line that are looked at to see whether it opens a record.
HEAD_OF_LINE = 4096


def last_start(path: str, start: int, end: int, opens: str) -> int:
    """Where the last record before ``end`` begins; ``start`` if none does after it."""
    rule, found = re.compile(opens), start
    with open(path, "rb") as f:
        for at, _, text, _ in lines_between(f, max(start, end - LOOK_BACK), end, HEAD_OF_LINE):
            if rule.match(text):
                found = at
    return found


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    stop: int
    until: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options["path"]
        self.mode = options.get("from", "checkpoint")
        self.most = int(options.get("max_line_bytes", MAX_LINE_BYTES))
        self.budget = int(options.get("max_bytes", 0))
        self.opens = options.get("multiline") or None
        self.once = options.get("once") == "true"
        self.checkpoint = options.get("checkpoint")
        self.last: dict[str, dict] | None = None

    def _resumed(self) -> dict[str, dict]:
        """The offsets that the stream's own checkpoint planned last."""
        if not self.checkpoint:
            return {}
        where = f"{self.checkpoint.removeprefix('file://')}/offsets"
        numbers = [int(n) for n in os.listdir(where) if n.isdigit()] if os.path.isdir(where) else []
        if not numbers:
            return {}
        with open(f"{where}/{max(numbers)}") as f:
            return json.loads(json.loads(f.read().splitlines()[-1])["files"])

    def _known(self) -> dict[str, dict]:
        if self.last is None:
            self.last = self._resumed()
        return self.last

    def _files(self) -> dict[str, str]:
        """Paths by inode: of the pattern, and of known files that were moved beside it."""
        def key(path: str) -> str:
            st = os.stat(path)
            return f"{st.st_dev}:{st.st_ino}"

        found = {key(p): p for p in sorted(glob.glob(self.pattern)) if os.path.isfile(p)}
        for k, was in self._known().items():
            if k not in found and os.path.isdir(d := os.path.dirname(was["path"]) or "."):
                found |= {k: e.path for e in os.scandir(d) if e.is_file() and key(e.path) == k}
        return found

    def _place(self, old: dict | None, sig: str, size: int) -> int:
        return decide((old["sig"], old["at"]) if old else None, sig, size)[0]

    def initialOffset(self) -> dict:
        if self.mode != "end":
            return {"files": "{}"}
        return {"files": json.dumps({k: {"path": p, "sig": signature(p), "at": whole_lines(p, os.path.getsize(p))} for k, p in self._files().items()})}

    def latestOffset(self) -> dict:
        known, out, left = self._known(), {}, self.budget
        for k, p in sorted(self._files().items(), key=lambda kp: kp[1]):
            sig, size = signature(p), os.path.getsize(p)
            at = self._place(known.get(k), sig, size)
            end = whole_lines(p, size)
            if self.opens and not self.once:
                end = last_start(p, at, end, self.opens)
            if self.budget and end - at > left:
                end = min(end, self._boundary(p, at, max(0, left), end))
            left -= end - at
            out[k] = {"path": p, "sig": sig, "at": max(at, end)}
        self.last = out
        return {"files": json.dumps(out)}

    def _boundary(self, path: str, at: int, room: int, end: int) -> int:
        """The end of the line or record that spans ``room`` bytes on; at least one."""
        if room <= 0 and self.budget:
            return at
        with open(path, "rb") as f:
            for a, _, _, _, _ in records_between(f, at + room, end, self.most, self.opens, end):
                return a
        return end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        for k, now in after.items():
            at = self._place(before.get(k), now["sig"], now["at"])
            out += [Piece(now["path"], a, min(a + RANGE_BYTES, now["at"]), now["at"]) for a in range(at, now["at"], RANGE_BYTES)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        """The lines or records that begin in the piece."""
        f, _ = open_file(piece.path)
        with f:
            who = origin(piece.path, f)
            for record in records_between(f, piece.start, piece.stop, self.most, self.opens, piece.until):
                yield piece.path, who, *record

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, start: str = "checkpoint", **options: object) -> DataFrame:
    """``options``: max_line_bytes, max_bytes (of a micro-batch), multiline, once, checkpoint."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", path).option("from", start)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()


def ingest(records: DataFrame, catalog: Catalog, index: str, chain: list[Processor], checkpoint: str, id_mode: str = "offset", seconds: float | None = None):
    """Start a stream of ``records`` into an index: each micro-batch is one commit, done once
    however often it is replayed. Without ``seconds`` the stream ends with the input."""
    if not catalog.exists(index):
        catalog.create(index)
    key = doc_id(id_mode, F.col("message"), F.col("origin"), F.col("offset"))

    def store(batch: DataFrame, number: int) -> None:
        catalog.put_frame(index, process(batch, chain, key), (checkpoint, number))

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def progress(query) -> dict[str, float]:
    """Rows and rates of a stream's run so far."""
    recent = query.recentProgress
    rows = reduce(lambda n, p: n + p["numInputRows"], recent, 0)
    ms = reduce(lambda n, p: n + p["durationMs"].get("triggerExecution", 0), recent, 0)
    return {"records": rows, "records_per_second": round(rows / (ms / 1000), 1) if ms else 0.0, "batches": len(recent)}
