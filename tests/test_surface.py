"""Settings, the command line, HTTP, explanations, extension hooks and the envelope's corners."""

import http.client
import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.engine import VERSION, Quarry
from quarry.errors import ConfigurationError, MappingError, PluginError, UnsupportedFeatureError
from quarry.functions.analysis import ANALYZERS, ASCII_FOLDING, LOWERCASE, TOKENIZERS, Analyzer, Filter, fold, stop
from quarry.server import server
from quarry.settings import Settings, load_settings


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Quarry(spark, str(tmp_path_factory.mktemp("surface")), Settings(max_sort_candidates=3, max_commits=2))
    e.create_index("notes", {"properties": {"body": {"type": "text"}, "tag": {"type": "keyword"}, "rank": {"type": "long"}, "flat": {"type": "text", "index_options": "freqs"}}})
    e.index_documents("notes", [{"body": f"red fox {k} " + "jumps " * k, "tag": "ab"[k % 2], "rank": 10 - k, "flat": "x y"} for k in range(6)], [f"d{k}" for k in range(6)])
    return e


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"max_commits": 5, "port": "81"}')
    got = load_settings(str(tmp_path / "s.json"), {"QUARRY_PORT": "82", "QUARRY_PLUGINS": "a,b", "OTHER": "x"}, host="0.0.0.0")
    assert (got.max_commits, got.port, got.plugins, got.host, got.max_sort_candidates) == (5, 82, ("a", "b"), "0.0.0.0", None)
    for bad in ({"nothing": 1}, {"port": "many"}, {"port": 70000}, {"max_commits": 0}, {"log_format": "xml"}, {"trigger_seconds": 0}, {"strict_plugins": "maybe"}):
        with pytest.raises(ConfigurationError):
            load_settings(env={}, **bad)


def test_candidate_cap_and_max_score(engine):
    r = engine.search("notes", "_exists_:rank | sort rank")
    assert r["engine"]["sort_truncated"] and r["engine"]["max_sort_candidates"] == 3 and r["hits"]["total"]["value"] == 6
    assert [h["_id"] for h in r["hits"]["hits"]] == ["d2", "d1", "d0"]
    r = engine.search("notes", "body:jumps", size=2)
    assert r["hits"]["max_score"] == r["hits"]["hits"][0]["_score"] and "sort_truncated" not in r["engine"]
    r = engine.search("notes", {"query": {"match_all": {}}, "size": 0, "aggs": {"t": {"terms": {"field": "tag", "size": 1}}, "r": {"terms": {"field": "rank"}}}})
    assert r["hits"]["hits"] == [] and r["hits"]["max_score"] is None and r["hits"]["total"]["value"] == 6
    assert r["aggregations"]["t"]["buckets"] == [{"key": "a", "doc_count": 3}] and r["aggregations"]["t"]["sum_other_doc_count"] == 3
    assert len(r["aggregations"]["r"]["buckets"]) == 6
    assert engine.search("notes", "body:nothing | stats count() by tag")["aggregations"]["stats"]["buckets"] == []


def test_phrase_guard_and_explanation(engine):
    with pytest.raises(UnsupportedFeatureError):
        engine.search("notes", 'flat:"x y"')
    assert engine.search("notes", "flat:x")["hits"]["total"]["value"] == 6
    shown = engine.search("notes", 'body:"red fox" AND NOT tag:a')["engine"]["query"]
    assert json.loads(json.dumps(shown)) == shown and "phrase" in json.dumps(shown)


def test_stored_postings_answer_like_terms(engine):
    from dataclasses import replace

    from quarry.operators.score import matches
    from quarry.plans import pql

    engine.index_documents("notes", [{"body": "red red dog", "tag": "c"}], ["d1"])
    engine.delete_document("notes", "d4")
    ix = engine.catalog.frame("notes")
    bare = replace(ix, postings=None, live=None)
    assert ix.live["n"] == 5 and ix.postings is not None
    for text in ("body:red", 'body:"red fox"', "body:r*", "body:red AND NOT body:jumps", "body:fox OR tag:c", "NOT body:fox", 'body:(dog OR "fox 3")', "_exists_:body", "body:red AND body:re*"):
        rows = [sorted((r["doc_id"], round(r["score"], 9)) for r in matches(x, pql.parse(text, ix.mapping).query).collect()) for x in (ix, bare)]
        assert rows[0] == rows[1] and rows[0], text
    engine.refresh("notes")
    assert engine.stats("notes")["segment_count"] == 2
    engine.index_documents("notes", [{"body": "one more"}], ["d9"])
    engine.refresh("notes")
    assert engine.stats("notes")["segment_count"] == 1 and engine.catalog.frame("notes").live["n"] == 6
    engine.delete_document("notes", "d9")


def test_update_mapping(engine):
    engine.create_index("mapped")
    engine.index_documents("mapped", [{"n": 1}], ["a"])
    assert engine.update_mapping("mapped", {"properties": {"m": {"type": "keyword"}}})["m"]["type"] == "keyword"
    with pytest.raises(MappingError):
        engine.update_mapping("mapped", {"properties": {"n": {"type": "text"}}})
    engine.index_documents("mapped", [{"m": "x"}], ["b"])
    assert engine.search("mapped", "m:x")["hits"]["total"]["value"] == engine.search("mapped", "n:1")["hits"]["total"]["value"] == 1


def test_hooks(engine):
    engine.register_analyzer("upper", Analyzer(TOKENIZERS["whitespace"], (Filter(change=F.upper, change_python=str.upper),)))
    assert engine.analyze("a b", "upper") == [("A", 0), ("B", 1)]
    engine.register_processor("same", lambda doc: doc)
    with pytest.raises(PluginError):
        engine.on("nothing", print)
    made = []
    engine.on("index_created", lambda index: made.append(index))
    engine.create_index("hooked", {"properties": {"t": {"type": "text", "analyzer": "upper"}}})
    engine.index_documents("hooked", [{"t": "small words"}], ["1"])
    assert made == ["hooked"] and engine.search("hooked", "t:SMALL")["hits"]["total"]["value"] == 1
    del ANALYZERS["upper"]


def test_filters_drop_and_fold_alike(spark):
    texts = ["Ærø ﬁn ½ Ｆull ªº naïve Straße 東京 İstanbul ΣΑΣ Σ'α é", "The THE the x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    blank = Filter(change=lambda x: F.regexp_replace(x, "x", ""), change_python=lambda x: x.replace("x", ""), empties=True)
    for a in (Analyzer(TOKENIZERS["standard"], (LOWERCASE, ASCII_FOLDING)), Analyzer(TOKENIZERS["standard"], (stop(frozenset({"The"})),)), Analyzer(TOKENIZERS["standard"], (LOWERCASE, blank)), ANALYZERS["standard"]):
        w, at = a.columns(F.col("t"))
        got = df.select(w.alias("w"), (at if at is not None else F.transform(w, lambda x, i: i)).alias("p")).collect()
        assert [list(zip(r["w"], r["p"])) for r in got] == [a.analyze(t) for t in texts]
    every = [chr(k) for k in range(0xA0, 0x3000) if chr(k).isalnum()]
    shown = spark.createDataFrame([("".join(every[k : k + 7]),) for k in range(0, len(every), 7)], "t string")
    assert all(r[1] == fold(r[0]) for r in shown.select("t", ASCII_FOLDING.change(F.col("t"))).collect())


def test_command_line(engine, tmp_path, capsys):
    root = str(tmp_path / "root")

    def run(*argv, code=0):
        assert cli.main(["--root", root, *argv]) == code
        out = capsys.readouterr()
        return json.loads(out.out if code == 0 else out.err)

    (tmp_path / "m.json").write_text('{"properties": {"level": {"type": "keyword"}}}')
    (tmp_path / "a.log").write_text('{"level": "ERROR"}\n{"level": "INFO"}\n')
    (tmp_path / "b.ndjson").write_text('{"index": {"_id": "z"}}\n{"level": "WARN"}\n')
    assert run("create", "logs", "--mapping", str(tmp_path / "m.json")) is None and run("list") == ["logs"]
    assert run("ingest", str(tmp_path / "a.log"), "logs", "--processor", "json_line", "--checkpoint", str(tmp_path / "cp" / "a"))["live_count"] == 2
    (place,) = run("status", str(tmp_path / "cp")).values()
    assert list(place["files"].values())[0]["offset"] == 37 and run("reset", str(tmp_path / "cp" / "a"), "--index", "logs") is True
    assert run("bulk", str(tmp_path / "b.ndjson"), "--index", "logs")["errors"] is False
    assert run("put", "logs", '{"level": "ERROR"}', "--id", "p")== ["p"] and run("get", "logs", "p") == {"level": "ERROR"}
    assert len(run("search", "logs", '{"query": {"match_all": {}}}', "--dsl", "--size", "1")["hits"]["hits"]) == 1
    assert run("search", "logs", "level:ERROR")["hits"]["total"]["value"] == 2 and run("remove", "logs", "p") is True
    assert run("analyze", "A b") == [["a", 0], ["b", 1]] and run("stats", "logs")["live_count"] == 3
    (tmp_path / "more.json").write_text('{"properties": {"n": {"type": "long"}}}')
    assert run("map", "logs", str(tmp_path / "more.json"))["n"] == {"type": "long"} and run("show", "logs")["n"] == {"type": "long"}
    assert run("refresh", "logs") is None and run("merge", "logs") is None and run("plugins") == [] and run("info")["version"] == VERSION
    assert run("search", "nowhere", "x", code=1)["type"] == "index_not_found" and run("search", "logs", "{", "--dsl", code=1)["type"] == "invalid_query"
    assert run("delete", "logs") is None and run("list") == []
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == VERSION
    with pytest.raises(SystemExit) as e:
        cli.main(["shout"])
    assert e.value.code == 2


def test_http(engine, tmp_path):
    with server(engine, port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()

        def ask(method, path, body=None):
            c = http.client.HTTPConnection(*s.server_address, timeout=120)
            c.request(method, path, json.dumps(body) if isinstance(body, dict) else body)
            r = c.getresponse()
            text = r.read().decode()
            return r.status, json.loads(text) if text else None

        assert ask("GET", "/")[1]["name"] == "quarry" and ask("GET", "/_health")[1]["status"] == "green"
        assert ask("PUT", "/web", {"mappings": {"properties": {"level": {"type": "keyword"}}}})[0] == 200 and ask("PUT", "/web")[0] == 409
        assert ask("HEAD", "/web") == (200, None) and ask("HEAD", "/none") == (404, None)
        assert ask("PUT", "/web/_doc/1", {"level": "ERROR", "m": "disk full"})[0] == 201 and len(ask("POST", "/web/_doc", {"level": "INFO"})[1]["_id"]) == 32
        assert ask("GET", "/web/_doc/1")[1]["_source"]["m"] == "disk full" and ask("GET", "/web/_doc/2")[0] == 404
        assert ask("POST", "/web/_bulk", '{"index": {"_id": "3"}}\n{"level": "WARN"}\n')[1]["items"][0]["index"]["status"] == 201
        assert ask("GET", "/web/_search?q=level:ERROR&size=1")[1]["hits"]["total"]["value"] == 1
        assert ask("POST", "/web/_search", {"query": {"term": {"level": "WARN"}}})[1]["hits"]["hits"][0]["_id"] == "3"
        assert ask("POST", "/web/_pql", {"query": "m:disk"})[1]["hits"]["total"]["value"] == 1
        assert ask("POST", "/web/_analyze", {"text": "A b"})[1]["tokens"] == [{"token": "a", "position": 0}, {"token": "b", "position": 1}]
        assert ask("PUT", "/web/_mapping", {"properties": {"n": {"type": "long"}}})[1]["web"]["mappings"]["n"] == {"type": "long"}
        assert {r["index"] for r in ask("GET", "/_cat/indices")[1]} >= {"web", "notes"} and ask("GET", "/web/_stats")[1]["web"]["live_count"] == 3
        (tmp_path / "w.log").write_text("one\ntwo\n")
        assert ask("POST", "/_ingest/file", {"path": str(tmp_path / "w.log"), "index": "lines"})[1]["live_count"] == 2
        status, got = ask("POST", "/_ingest/file", {"path": str(tmp_path / "w.log"), "index": "tailed", "checkpoint": str(tmp_path / "cp")})
        assert status == 202
        engine.streams[got["job"]].awaitTermination()
        job = "/_ingest/jobs/" + got["job"].replace("/", "%2F")
        assert ask("GET", job)[1]["state"] == "done" and got["job"] in ask("GET", "/_ingest/jobs")[1] and ask("DELETE", job)[0] == 200
        assert ask("POST", "/web/_refresh")[0] == ask("POST", "/web/_forcemerge")[0] == 200 and ask("GET", "/_plugins")[1] == {"plugins": []}
        assert ask("DELETE", "/web/_doc/1")[1]["result"] == "deleted" and ask("DELETE", "/web/_doc/1")[0] == 404
        assert ask("POST", "/web/_search", "{")[0] == 400 and ask("POST", "/web/_search", {"query": {"fuzzy": {}}})[1]["error"]["type"] == "unsupported_feature"
        assert ask("GET", "/a/b/c")[0] == 404 and ask("DELETE", "/_health")[0] in (404, 405) and ask("GET", "/none/_search?q=x")[0] == 404 and ask("GET", "/web/_search?q=x&size=y")[0] == 400
        assert ask("DELETE", "/web")[0] == 200
        s.shutdown()
