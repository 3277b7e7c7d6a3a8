"""What a query costs beyond its rows: how often texts are read, and over how many tasks."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry import queries as engine_queries
from quarry.operators import postings
from quarry.operators.score import matches
from quarry.plans import pql
from quarry.plans.ast import Phrase
from quarry.streaming import processors

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_postings(monkeypatch):
    def refuse(*args):
        raise AssertionError("postings were built for one query")

    monkeypatch.setattr(postings, "persist", refuse)
    monkeypatch.setattr(engine_queries, "_KEPT", {})


def scores(df):
    return sorted((r[0], r["score"]) for r in df.collect())


def test_phrases_need_no_postings(spark, no_postings):
    """F1: a phrase is counted as the texts are read, once, and scored from its counts."""
    ix = engine_queries.index(spark, SF, "documents")
    for leaf in (Phrase("text", ("of", "the"), slop=2), Phrase("text", ("of", "the")), Phrase("text", ("the", "the"), slop=3)):
        got = engine_queries.found(spark, SF, "documents", leaf)[1]
        assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
        assert scores(got.select("doc_ord", F.round("score", 9).alias("score"))) == scores(matches(ix, leaf).select("doc_ord", F.round("score", 9).alias("score")))
    assert len(entry.queries()["phrase_slop"](spark, SF).collect()) > 0


def test_statistics_need_no_postings(spark, no_postings):
    """the number and lengths of documents come from the texts alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lengths = [min(255, len(engine_queries.analysis.ANALYZERS["standard"].analyze(r["text"] or ""))) for r in docs]
    assert [tuple(r) for r in entry.queries()["index_stats"](spark, SF).collect()] == [(len(docs), round(sum(lengths) / len(docs), 6))]


def test_terms_are_scanned_without_postings(spark, no_postings):
    """distinct terms of a range need no postings."""
    words = {t for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for t, _ in engine_queries.analysis.ANALYZERS["standard"].analyze(r["text"] or "")}
    assert [r["term"] for r in entry.queries()["term_scan"](spark, SF).collect()] == sorted(w for w in words if "ma" <= w < "n")


def test_postings_are_grouped_in_their_documents(spark):
    """one row a term and document is shuffled, not one a token."""
    df = spark.createDataFrame([(1, "b a b A"), (2, None), (3, ""), (4, "ß b"), (5, "one")], "doc_id bigint, text string")
    built = postings.build(engine_queries.from_table(df, engine_queries.MAPPINGS["documents"][0], "doc_id"))
    assert "collect_list" not in built._jdf.queryExecution().optimizedPlan().toString()
    assert built.schema.simpleString() == "struct<" + postings.SCHEMA.replace(", ", ",").replace(" ", ":") + ">"
    got = sorted((r["term"], r["doc_ord"], r["tf"], r["positions"], r["dl"]) for r in built.collect())
    assert got == [("a", 1, 2, [1, 3], 4), ("b", 1, 2, [0, 2], 4), ("b", 4, 1, [1], 2), ("one", 5, 1, [0], 1), ("ß", 4, 1, [0], 2)]
    assert [r["term"] for r in postings.scan(postings.terms(engine_queries.from_table(df, engine_queries.MAPPINGS["documents"][0], "doc_id")), "text").collect()] == ["a", "b", "one", "ß"]


def test_bare_words_need_no_postings(spark, no_postings):
    """a bare word, like every text leaf, is counted as the texts are read, once."""
    ix = engine_queries.index(spark, SF, "documents")
    for text in ("of", "of AND NOT text:the", "text:th* OR lang:de", "text:(th* OR of) AND text:re*", "_exists_:text AND of"):
        node = pql.parse(text, ix.mapping).query
        got = engine_queries.found(spark, SF, "documents", node)[1]
        assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
        rows = [scores(x.select("doc_ord", F.round("score", 9).alias("score"))) for x in (got, matches(ix, node))]
        assert rows[0] == rows[1] and rows[0], text
    assert len(entry.queries()["bare_word"](spark, SF).collect()) > 0


def test_a_document_is_folded_at_once(spark):
    """folding is a call a document, not a token, and gives what it gave term by term."""
    a = engine_queries.analysis.Analyzer(engine_queries.analysis.TOKENIZERS["standard"], (engine_queries.analysis.LOWERCASE, engine_queries.analysis.ASCII_FOLDING))
    blank = engine_queries.analysis.Analyzer(engine_queries.analysis.TOKENIZERS["whitespace"], (engine_queries.analysis.ASCII_FOLDING,))
    texts = ["Ærø ﬁn ½ Ｆull ªº naïve Straße 東京 İstanbul", "東 京 é", "ﷺ a ﷺ", "plain words", "é", "", "é\x01ö \x01 x\x01", "東\x01 京", "a \x01é 東 \x01", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for x in (a, blank):
        w, at = x.columns(F.col("t"))
        got = df.select("k", w.alias("w"), F.lit(None).alias("p") if at is None else at.alias("p")).orderBy("k").collect()
        assert [r["w"] for r in got] == [None if t is None else [y for y, _ in x.analyze(t)] for t in texts]
    plan = df.select(a.columns(F.col("t"))[0].alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(lambda" in plan


def test_times_are_read_once(spark):
    """no step is worked out again to look for dropped records, and a shape's parts are
    found by one matching."""
    df = spark.createDataFrame([(1, "02/Jan/2024:03:04:05 +0130: x"), (2, "none at all"), (3, "2024-01-02\n"), (4, None)], "id bigint, message string")
    got = processors.process(df, [processors.timestamp(year=2023)], F.col("id").cast("string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format") == 1 and "regexp_extract(" not in plan.lower()
    assert [json.loads(r["source"]).get("@timestamp") for r in got.orderBy("doc_id").collect()] == ["2024-01-02T01:34:05.000Z", None, "2024-01-02T00:00:00.000Z", None]
    dropping = processors.process(df, [processors.rows(lambda doc: None if doc.get("message") is None else doc), processors.timestamp()], F.col("id").cast("string"))
    assert dropping.count() == 3


def test_lines_are_read_by_all_cores(spark):
    """a table of one file doesn't leave the work to one task."""
    for name in ("ingest_timestamp", "ingest_timestamp_shapes", "ingest_json_line", "ingest_regex_extract"):
        assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
