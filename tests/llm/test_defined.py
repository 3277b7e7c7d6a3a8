"""Defined cases: names that clash, ids beyond 2^53 beside nulls, empty and long texts, ties."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, packing, pii, quality, secrets, simhash, suffix, topk, toxicity, warc

BIG = (1 << 60) + 1
#: Names that operators use inside, dotted and quoted ones.
NAMES = ["a.b", "q_empty", "q_host", "s_id", "s_key", "p_marks", "p_new", "m_source", "m_copies", "l_q", "c0", "c99", "mark", "absent", "place", "blob", "h", "r_spans", "odd `name`"]
TEXT = " ".join(f"word{k}" for k in range(70)) + " mail ann@site.org now"
KEEPING = {"keep_good": quality.keep_good, "keep_one": simhash.keep_one, "redact": pii.redact, "mix": mixing.mix, "drop_repeats": suffix.drop_repeats}
GIVING = {
    "assess": quality.assess, "scan": secrets.scan_documents, "extract": pii.extract, "passages": suffix.repeated_passages, "groups": simhash.groups,
    "pack": packing.pack, "pack_texts": packing.pack_texts, "allocate": mixing.allocate, "classify": lambda d: toxicity.classify(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT, "a"), (BIG + 2, TEXT, "a"), (None, TEXT, "a"), (BIG + 4, None, None), (BIG + 6, "", "b"), (BIG + 8, "token=" + "k" * 20, "b"), (BIG, TEXT, "a")]
    extra = [F.lit(f"mine {n}").alias(n) for n in NAMES]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").select("doc_id", "text", "source", *extra)
    return df.repartition(1)


@pytest.mark.parametrize("name", KEEPING)
def test_kept_columns_are_the_callers(docs, name):
    got = KEEPING[name](docs)
    rows = got.collect()
    assert got.columns == docs.columns and rows
    assert {tuple(r)[3:] for r in rows} == {tuple(f"mine {n}" for n in NAMES)}
    assert {r["doc_id"] for r in rows} <= {BIG, BIG + 2, None, BIG + 4, BIG + 6, BIG + 8}
    assert KEEPING[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", GIVING)
def test_ids_are_exact_beside_nulls(docs, name):
    got = GIVING[name](docs)
    ids = {r[0] for r in got.collect()}
    want = {"scan": {BIG + 8}, "passages": {BIG, BIG + 2}, "groups": {BIG, BIG + 2}, "extract": {BIG, BIG + 2, None}}.get(name)
    assert ids == want if want else ids <= {BIG, BIG + 2, None, BIG + 4, BIG + 6, BIG + 8} and {BIG, BIG + 8} <= ids
    assert GIVING[name](docs.limit(0)).select(got.columns).count() == 0


def test_scores_keep_ids(docs):
    texts = [f"{w} some other words here {k}" for k in range(40) for w in ("vile", "kind")]
    net, threshold = toxicity.fit(texts, [1, 0] * 40)
    got = toxicity.score_documents(docs, net, threshold).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted([BIG, BIG, BIG + 2, 0, BIG + 4, BIG + 6, BIG + 8])
    long = toxicity.score_documents(docs.limit(1).withColumn("text", F.repeat(F.lit("vile word "), 50_000)), net, threshold).collect()
    assert long[0]["n_windows"] == -(-(100_000 - toxicity.WINDOW) // toxicity.STRIDE) + 1


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k % 10, f"text {k}") for k in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k % 10, int(k % 10 < 5)) for k in range(30)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels, train_rows=2)
    assert sorted(toxic) == [0, 0, 0, 0, 1, 1] and len(texts) == 6


def test_long_texts_and_a_long_record(spark, tmp_path):
    long = " ".join(f"w{k % 5003}x{k % 97}" for k in range(200_000))
    docs = spark.createDataFrame([(BIG, long, "a"), (BIG + 2, long + " end", "a")], "doc_id bigint, text string, source string")
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["drop"]) for r in suffix.repeated_passages(docs).collect()} == {(BIG, 0, 200_000, False), (BIG + 2, 0, 200_000, False), (BIG + 2, 0, 200_000, True)}
    assert [r["text"] for r in suffix.drop_repeats(docs).orderBy("doc_id").collect()] == [long, " end"]
    assert {r["group_size"] for r in simhash.groups(docs).collect()} == {2}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.lit(1).alias("a.b"), F.lit(2).alias("file"))
    assert {(r["page_id"], r["length"]) for r in warc.round_trip(pages).collect()} == {(BIG, len(long)), (BIG + 2, len(long) + 4)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_vectors_with_clashing_columns_and_ties(spark):
    rows = [(BIG + k, [1.0, float(k % 2)], 1, "x") for k in range(6)] + [(None, [1.0, 1.0], 1, "x"), (BIG, [1.0, 0.0], 2, "y")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, bucket int, `theta.x` string")
    got = {}
    for r in topk.top_k(df, 2).collect():
        got.setdefault(r["vec_id"] - BIG, []).append((r["rank"], r["neighbor_id"] - BIG))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {0: [1, 2], 1: [3, 5], 2: [0, 1], 3: [1, 5], 4: [0, 1], 5: [1, 3]}


def test_pipeline_of_nulls(spark, tmp_path):
    rows = [(None, None, None, None, None), (BIG, None, "en", "a", 0), (None, "only a few words", None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["text"]) for r in got] in ([], [(None, "only a few words")])
