"""Reading lines and records by ranges, following files, jobs, repeated ids and conflicts."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.engine import Quarry
from quarry.errors import IngestError, MappingError
from quarry.settings import Settings
from quarry.sources.lines import read_lines
from quarry.streaming import tail


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Quarry(spark, str(tmp_path_factory.mktemp("ingest")), Settings(trigger_seconds=0.2))


def naive(data, most):
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        stop = end + 1 if end >= 0 else len(data)
        body = data[at : end if end >= 0 else len(data)]
        if end >= 0:
            body = body.removesuffix(b"\r")
        out.append((at, stop, body[:most].decode("utf-8", "replace"), len(body) > most))
        at = stop
    return out


@pytest.mark.parametrize("most", [5, 40, 1 << 20])
def test_lines_are_exact_whatever_the_ranges(spark, tmp_path, most):
    data = b"ab\xff\xfecd\n\r\nx\r\n" + "é".encode() * 30 + b"\n\n" + b"y" * 41 + b"\r\n" + b"z" * 40 + b"\r\nlast \xf0"
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "empty.log").write_bytes(b"")
    for size in (1, 7, 64, 1 << 20):
        got = read_lines(spark, str(tmp_path / "*.log"), most, range_bytes=size).collect()
        assert sorted((r["offset"], r["end_offset"], r["message"], r["truncated"]) for r in got) == naive(data, most)


def test_a_line_above_the_default_cap(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("é".encode() * 600_000 + b"\nnext\n")
    got = sorted(map(tuple, read_lines(spark, str(tmp_path / "a.log")).select("offset", F.octet_length("message").alias("n"), "truncated").collect()))
    assert got == [(0, 1 << 20, True), (1_200_001, 4, False)]


@pytest.mark.parametrize("size", [3, 20, 1 << 20])
def test_records_span_ranges(spark, tmp_path, size):
    text = "lead in\n  more\n1 one\n at a\n at b\n2 two\n3 three\n at c\n"
    (tmp_path / "a.log").write_text(text)
    got = [(r["message"], r["line_count"], r["offset"]) for r in read_lines(spark, str(tmp_path / "a.log"), opens=r"\d ", range_bytes=size).orderBy("offset").collect()]
    assert got == [("lead in\n  more", 2, 0), ("1 one\n at a\n at b", 3, 15), ("2 two", 1, 33), ("3 three\n at c", 2, 39)]


def messages(engine, name):
    return sorted(h["_source"]["message"] for h in engine.search(name, "_exists_:message", size=100)["hits"]["hits"])


@pytest.mark.parametrize("pattern", ["app.log", "app*.log*"])
def test_rotation_drains_and_repeats_nothing(engine, tmp_path, pattern):
    log, name = tmp_path / "app.log", f"rot{len(pattern)}"
    run = lambda: engine.follow(str(tmp_path / pattern), name, str(tmp_path / "cp"), once=True).awaitTermination()
    log.write_text("one\ntwo\n")
    run()
    with log.open("a") as f:
        f.write("three\n")
    os.rename(log, tmp_path / "app.log.1")
    log.write_text("four\n")
    run()
    run()
    assert messages(engine, name) == ["four", "one", "three", "two"]
    # the same lines read in one go have the same ids
    engine.ingest_file(str(tmp_path / "app.log"), name)
    engine.ingest_file(str(tmp_path / "app.log.1"), name)
    assert engine.stats(name)["live_count"] == 4
    # cut and written anew
    log.write_text("5\n")
    run()
    assert messages(engine, name) == ["5", "four", "one", "three", "two"]


def test_batches_are_bounded(tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text(f"line {k}\n" * 100)
    reader = tail.TailReader({"path": str(tmp_path / "*.log"), "max_bytes": "1000"})
    at, seen = reader.initialOffset(), []
    for _ in range(10):
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(at, end) for r in reader.read(p)]
        seen += [(r[0], r[2]) for r in rows]
        assert sum(r[3] - r[2] for r in rows) <= 1000 + 7
        at = end
    assert len(seen) == len(set(seen)) == 300


def test_follow_records_jobs_and_checkpoints(engine, tmp_path):
    log, cp = tmp_path / "in" / "a.log", str(tmp_path / "cps" / "one")
    log.parent.mkdir()
    log.write_text("A first\n more\nB second\n")
    engine.follow(str(log), "jobs", cp, multiline=r"[A-Z] ")

    def wait(n):
        until = time.time() + 60
        while engine.exists("jobs") and engine.stats("jobs")["live_count"] < n and time.time() < until:
            time.sleep(0.2)
        return messages(engine, "jobs")

    assert wait(1) == ["A first\n more"]
    assert engine.job(cp)["state"] == "running" and cp in engine.jobs()
    with pytest.raises(IngestError):
        engine.reset(cp)
    with log.open("a") as f:
        f.write(" tail\nC third\n")
    assert wait(2) == ["A first\n more", "B second\n tail"]
    assert engine.stop(cp)["state"] == "done"
    (place,) = engine.checkpoints(str(tmp_path / "cps")).values()
    assert place["files"][str(log)]["offset"] == len("A first\n more\nB second\n tail\n")
    engine.follow(str(log), "jobs", cp, multiline=r"[A-Z] ", once=True).awaitTermination()
    assert wait(3)[2] == "C third"
    assert engine.reset(cp) and engine.checkpoint(cp) is None and not engine.reset(cp)
    engine.follow(str(log), "jobs", cp, multiline=r"[A-Z] ", once=True).awaitTermination()
    assert engine.stats("jobs")["live_count"] == 3
    with pytest.raises(IngestError):
        engine.job("nothing")


def test_the_last_of_repeated_ids_stands(engine, spark):
    rows = [("a", json.dumps({"n": 9})), ("b", json.dumps({"n": 1})), ("a", json.dumps({"n": 10})), (None, json.dumps({"n": 0}))]
    engine.create_index("rep")
    engine.catalog.put_frame("rep", spark.createDataFrame(rows, "doc_id string, source string").coalesce(1))
    assert engine.get_document("rep", "a") == {"n": 10} and engine.stats("rep")["live_count"] == 3
    order = [h["_source"]["n"] for h in engine.search("rep", "_exists_:n")["hits"]["hits"]]
    assert order == [1, 10, 0]  # ties in the order of input


def test_conflicting_types_are_refused_whole(engine, spark):
    engine.create_index("typed", {"properties": {"n": {"type": "long"}, "at": {"type": "date"}}})
    make = lambda *docs: spark.createDataFrame([(str(k), json.dumps(d)) for k, d in enumerate(docs)], "doc_id string, source string")
    for bad in ({"n": "four"}, {"n": 1.5}, {"n": True}, {"at": "soon"}, {"at": 5}):
        with pytest.raises(MappingError):
            engine.catalog.put_frame("typed", make({"n": 1}, bad))
    assert engine.stats("typed") == {"doc_count": 0, "deleted_count": 0, "live_count": 0, "segment_count": 0, "next_ord": 0, "version": 0}
    engine.catalog.put_frame("typed", make({"n": [1, 2]}, {"n": None, "at": "2024-01-02", "new": {"x": 1}}))
    assert engine.search("typed", "n:2")["hits"]["total"]["value"] == 1 and engine.get_mapping("typed")["new.x"]["type"] == "long"
