"""The built-in processors against Python's own parsers."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.errors import PluginError
from quarry.streaming import processors
from quarry.streaming.processors import parse_time

TIMES = [
    "1700000000", "1700000000123", "1700000000.25", "-170000000", "12345678", "123456789012345", "170000000000.x", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.678901+01:30", "20240102T030405", "2024-01-02", "20240102",
    "2024-01-02T03", "2024-02-30", "02/Jan/2024:03:04:05 +0000", "2/jan/2024:3:4:5 -0130", "02/Foo/2024:03:04:05 +0000", "2024-01-02 03:04:05,678", "2024-1-2 3:4:5", "2024/01/02 03:04:05", "2024/13/02 03:04:05",
    "Jan 15 10:30:00", "jan  5 1:02:03", "Jun 31 10:30:00", "anf 15 10:30:00", "Tue, 02 Jan 2024 03:04:05 GMT", "02 Jan 2024 03:04:05 -0500", "2 Jan 2024 03:04 EST", "Tue, 02 Jan 2024 25:04:05 GMT", "soon", "", " 2024-01-02T03:04:05Z ",
]


def through(spark, messages, chain):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "id int, message string")
    got = processors.process(df, chain, F.col("id").cast("string"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    return {int(r["doc_id"]): json.loads(r["source"]) for r in got.collect()}


def test_times_in_fields(spark):
    docs = [json.dumps({"time": t}) for t in TIMES] + [json.dumps({"ts": x}) for x in (1700000000, 1.7e12, 5, True, None, 1e300, [1])]
    got = through(spark, docs, [processors.json_line, processors.timestamp(year=2023)])
    for k, d in enumerate(docs):
        value = next(iter(json.loads(d).values()))
        assert got[k].get("@timestamp") == parse_time(value, 2023), value


def test_times_at_the_start_of_messages(spark):
    messages = [*TIMES, *[f"{t}: some words" for t in TIMES if t], "word 1700000000", "Jan 15 10:30:00 host app[1]: text", "2024-01-02 03:04:05,678 INFO x", None]
    got = through(spark, messages, [processors.timestamp(year=2023)])
    for k, m in enumerate(messages):
        words = (m or "").split(maxsplit=4)[:4]
        want = next((t for n in range(1, len(words) + 1) if (t := parse_time(" ".join(words[:n]).rstrip(":,;"), 2023))), None)
        assert got[k].get("@timestamp") == want, m


def test_regex_and_json(spark):
    chain = [processors.json_line, processors.regex_extract(r"(?P<level>[A-Z]+)(?: code=(?P<code_no>\d+))? (?P<q>['\"]).*(?P=q)")]
    messages = ["x WARN code=7 'a' b", 'INFO "c"', "none", '{"message": "ERR code=1 \'z\'", "level": 5, "n": 1.5, "deep": {"a": [null, true]}}', "[1]", '"text"', '{"a": 1', None]
    got = through(spark, messages, chain)
    assert got[0] == {"message": messages[0], "level": "WARN", "code_no": "7", "q": "'"}
    assert got[1] == {"message": messages[1], "level": "INFO", "q": '"'}
    assert got[3] == {"message": "ERR code=1 'z'", "level": "ERR", "code_no": "1", "q": "'", "n": 1.5, "deep": {"a": [None, True]}}
    assert [got[k] for k in (2, 4, 5, 6)] == [{"message": messages[k]} for k in (2, 4, 5, 6)] and got[7].get("message") is None


def test_python_processors_drop_and_change(spark):
    keep = processors.rows(lambda doc: None if doc["message"] == "no" else doc | {"n": len(doc["message"])})
    df = spark.createDataFrame([("yes",), ("no",)], "message string")
    assert [json.loads(r["source"]) for r in processors.process(df, [keep]).collect()] == [{"message": "yes", "n": 3}]
    with pytest.raises(PluginError):
        processors.resolve(["nothing"])
