"""Postings: an inverted table (field, term, doc_ord, tf, positions, dl), written with an
index so that text leaves read the rows of their terms instead of all texts. It is sorted
by (field, term) within range partitions: files, row groups and pages that can't hold a
term, prefix or range are skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.analysis import let
from quarry.operators.frame import IndexFrame, c

SCHEMA = "field string, term string, doc_ord bigint, tf int, positions array<int>, dl int"
ROW_GROUP_BYTES = 8 << 20


def _runs(placed: Column) -> Column:
    """``placed``, pairs (term, pos) in order, as one (term, positions) a term."""

    def firsts(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x["t"]) - 1), lambda i: (i == 0) | (F.get(x["t"], i) != F.get(x["t"], i - 1)))
        return let(F.struct(x["t"].alias("t"), x["p"].alias("p"), at.alias("at")), cut)

    def cut(x: Column) -> Column:
        def run(a: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["at"], k + 1), F.size(x["t"]))
            return F.struct(F.get(x["t"], a).alias("term"), F.slice(x["p"], a + 1, end - a).alias("positions"))

        return F.transform(x["at"], run)

    return F.when(F.size(placed) > 0, let(F.struct(placed["term"].alias("t"), placed["pos"].alias("p")), firsts))


def build(index: IndexFrame) -> DataFrame:
    """Postings of every text field. A document's tokens are grouped within its row; its
    postings are shuffled once, to ranges of (field, term, doc_ord), so that a frequent term
    spreads over several."""
    parts = []
    for name in index.mapping.text_fields():
        if index.held(name) is None:
            continue
        at = c(f"{name}__pos") if f"{name}__pos" in index.columns else F.transform(c(f"{name}__terms"), lambda x, i: i)
        placed = index.df.select("doc_ord", c(f"{name}__dl").alias("dl"), F.sort_array(F.arrays_zip(c(f"{name}__terms").alias("term"), at.alias("pos"))).alias("placed"))
        each = placed.select("doc_ord", "dl", F.explode(_runs(F.col("placed"))).alias("x"))
        parts.append(each.select(F.lit(name).alias("field"), "x.term", "doc_ord", F.size("x.positions").alias("tf"), "x.positions", "dl"))
    if not parts:
        return index.df.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts).repartitionByRange("field", "term", "doc_ord")


def terms(index: IndexFrame) -> DataFrame:
    """(field, term) of every text field, as often as they occur: what :func:`scan` needs,
    without postings."""
    parts = [index.df.select(F.lit(n).alias("field"), F.explode(c(f"{n}__terms")).alias("term")) for n in index.mapping.text_fields() if index.held(n) is not None]
    return reduce(DataFrame.unionByName, parts) if parts else index.df.sparkSession.createDataFrame([], "field string, term string")


def write(postings: DataFrame, path: str) -> None:
    """Sorts what :func:`build` has put into ranges, and writes it."""
    postings.sortWithinPartitions("field", "term", "doc_ord").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def persist(index: IndexFrame, path: str) -> IndexFrame:
    """``index`` written below ``path`` with its postings and totals, and read from there: its
    texts are analyzed once, however many queries follow."""
    spark = index.df.sparkSession
    index.df.write.parquet(f"{path}/docs")
    kept = IndexFrame(spark.read.parquet(f"{path}/docs"), index.mapping, index.name, index.multi)
    write(build(kept), f"{path}/postings")
    totals = kept.df.agg(*kept.totals()).first()
    kept.postings, kept.live = spark.read.schema(SCHEMA).parquet(f"{path}/postings"), {"n": totals["n"], "sums": totals["sums"] or {}}
    return kept


def lookup(postings: DataFrame, field: str, term: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == term))


def scan(postings: DataFrame, field: str, prefix: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """The distinct terms of a field with a prefix or in [low, high), rising."""
    t = F.col("term")
    keep = F.col("field") == field
    keep = keep & t.startswith(prefix) if prefix is not None else keep
    keep = keep & (t >= low) if low is not None else keep
    keep = keep & (t < high) if high is not None else keep
    return postings.where(keep).select("term").distinct().orderBy("term")


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, total_tf)."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def every(streams: list[DataFrame]) -> DataFrame:
    """Documents in all of ``streams`` (doc_ord, score), scores summed."""
    tagged = reduce(DataFrame.unionByName, [s.select("doc_ord", "score", F.lit(i).alias("stream")) for i, s in enumerate(streams)])
    return tagged.groupBy("doc_ord").agg(F.sum("score").alias("score"), F.count_distinct("stream").alias("n")).where(F.col("n") == len(streams)).drop("n")
