from datetime import UTC, datetime

import pytest

from quarry.errors import InvalidQueryError, MappingError, UnsupportedFeatureError
from quarry.functions.analysis import ANALYZERS
from quarry.mapping import Mapping, infer, merge, parse_mapping, parse_millis, validate
from quarry.operators.score import idf
from quarry.plans import jsondsl, pql
from quarry.plans.ast import NO_MATCH, Bool, Exists, MatchAll, Phrase, Prefix, Range, Sort, Term
from quarry.sources.catalog import _grown
from quarry.streaming.processors import parse_time
from quarry.streaming.tail import classify, decide

M = parse_mapping({"properties": {"msg": {"type": "text"}, "level": {"type": "keyword"}, "code": {"type": "long"}, "at": {"type": "date"}, "ok": {"type": "boolean"}, "deep": {"type": "object", "properties": {"x": {"type": "double"}}}}})


@pytest.mark.parametrize(("text", "want"), [
    ("level:hot", Term("level", "hot")),
    ("msg:One", Term("msg", "one")),
    ("code:[1 TO 9]", Range("code", gte=1, lte=9)),
    ("deep.x:<2", Range("deep.x", lt=2.0)),
    ("msg:re*", Prefix("msg", "re")),
    ('msg:"a b"', Phrase("msg", ("a", "b"))),
    ("_exists_:code", Exists("code")),
    ("!level:a", Bool(must_not=(Term("level", "a"),))),
    ("code:1 && !level:a", Bool(must=(Term("code", 1),), must_not=(Term("level", "a"),))),
    ("level:(a || b)", Bool(should=(Term("level", "a"), Term("level", "b")))),
    ("word", Bool(should=(Term("msg", "word"),))),
    ("ok:1", Term("ok", True)),
    ("at:>=now-1d", Range("at", gte=parse_millis("2024-01-19T00:00:00"))),
])
def test_pql(text, want):
    assert pql.parse(text, M, datetime(2024, 1, 20, tzinfo=UTC)).query == want


def test_stages_and_positions():
    p = pql.parse("level:a | sort -code, at | limit 3 | fields msg,level | stats count() by level", M)
    assert (p.sort, p.limit, p.fields, p.stats) == ((Sort("code", True), Sort("at")), 3, ("msg", "level"), "level")
    for text, at in (("level:", 6), ("(level:a", 8), ("level:a | shout", 10), ("level:a | limit x", 16), ("#& x", 1)):
        with pytest.raises(InvalidQueryError) as e:
            pql.parse(text, M)
        assert e.value.detail["position"] == at
    for text in ('level:"x y"', "code:1*", "ok:>1"):
        with pytest.raises(UnsupportedFeatureError):
            pql.parse(text, M)
    with pytest.raises(InvalidQueryError):
        pql.parse("code:many", M)


def test_json():
    body = {"query": {"bool": {"must": {"match": {"msg": "a b"}}, "boost": 2}}, "sort": ["-code", {"at": "asc"}], "_source": "msg", "aggs": {"x": {"terms": {"field": "level"}}}}
    got = jsondsl.compile_body(M, body)
    assert got.query == Bool(must=(Bool(should=(Term("msg", "a", 2.0), Term("msg", "b", 2.0))),))
    assert got.sort == (Sort("code", True), Sort("at")) and got.source == ("msg",)
    assert jsondsl.compile_body(M, {}).query == MatchAll()
    assert jsondsl.compile_body(M, {"query": {"match": {"msg": "?!"}}}).query == NO_MATCH
    for bad, named in (({"query": {"fuzzy": {}}}, "fuzzy"), ({"highlight": 1}, "highlight"), ({"query": {"range": {"code": {"gte": 1, "format": 2}}}}, "format"), ({"aggs": {"x": {"avg": {}}}}, "x"), ({"query": {"match": {"msg": {"query": "a", "operator": "and"}}}}, "operator")):
        with pytest.raises(UnsupportedFeatureError, match=named):
            jsondsl.compile_body(M, bad)
    with pytest.raises(InvalidQueryError):
        jsondsl.compile_body(M, {"size": -1})


def test_mappings():
    m = infer(Mapping(), [{"a": "x", "b": {"c": 1}}, {"a": 5, "d": [None, True], "e": []}])
    assert {k: f.type for k, f in m.fields.items()} == {"a": "text", "a.keyword": "keyword", "b.c": "long", "d": "boolean"}
    with pytest.raises(MappingError):
        merge(m, parse_mapping({"properties": {"a": {"type": "long"}}}))
    with pytest.raises(MappingError):
        validate(m, {"b": {"c": True}})
    assert {k: f.type for k, f in _grown(Mapping(), "OBJECT<a: STRING, b: OBJECT<`c d`: BIGINT>, l: ARRAY<DECIMAL(2,1)>, z: VOID>").fields.items()} == {"a": "text", "a.keyword": "keyword", "b.c d": "long", "l": "double"}


def test_analysis_and_numbers():
    assert ANALYZERS["stop_en"].analyze("The cat of Rome") == [("cat", 1), ("rome", 3)]
    assert ANALYZERS["log"].analyze("a=1 [B:c]") == [("a", 0), ("1", 1), ("b", 2), ("c", 3)]
    assert round(idf(2, 1), 10) == 0.6931471806 and idf(0, 0) == 0


@pytest.mark.parametrize(("value", "want"), [
    (1700000000, "2023-11-14T22:13:20.000Z"), ("1700000000123", "2023-11-14T22:13:20.123Z"), ("2024-01-02T03:04:05+01:00", "2024-01-02T02:04:05.000Z"),
    ("02/Jan/2024:03:04:05 +0000", "2024-01-02T03:04:05.000Z"), ("2024-01-02 03:04:05,678", "2024-01-02T03:04:05.678Z"), ("Jan 15 10:30:00", "2023-01-15T10:30:00.000Z"),
    ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05.000Z"), ("soon", None), (True, None),
])
def test_times(value, want):
    assert parse_time(value, 2023) == want


def test_resume():
    assert classify(None, 0, "a", 1) == "fresh" and classify("a", 5, "b", 9) == "rotated"
    assert classify("a", 5, "a", 4) == "truncated" and classify("1:2:short", 5, "1:2:ff", 9) == "unchanged"
    assert decide(("a", 5), "a", 9) == (5, "resume") and decide(None, "a", 9, "end") == (9, "end") and decide(("a", 5), "b", 9) == (0, "restart_rotated")
