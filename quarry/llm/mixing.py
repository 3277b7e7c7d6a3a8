"""Mixing sources to target weights by Pareto order sampling.

A budget of rows is split among the sources by their weights (largest remainders, so each
share T is a whole number). Within a source a document's expected copies are
e = T * size / sum(size) with size = sqrt(1 + characters). floor(e) whole copies are
certain; of the fractions f = e - floor(e), whose sum is the whole number
T - sum(floor(e)), exactly that many documents get one copy more: those of the least
(u / (1 - u)) / (f / (1 - f)), u being a hash of doc_id in (0, 1).

The rank limit of a source is found by histogram: odds are binned, the bin that holds the
limit is found from counts, and only that bin's distinct keys are sorted, rows alike being
counted first; no source, however hot, is sorted in one task. Remainders of the shares are
ranked in ranges, so there may be as many sources as there are hosts. Texts are read twice
by :func:`mix` (sizes and hashes first, then the rows) and once by :func:`allocate`.

Defined cases: a null source is a source of its own; a null text has 0 characters; a null
doc_id hashes as the word null; ties in the rank go by doc_id and text hash; of rows alike
in all three as many are taken as the share has left, the first in the order of the input;
a source without a given weight has weight 0; extra columns are kept by :func:`mix` under
any names and ignored by :func:`allocate`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import numbered, plain, saved, small_side

TEMPERATURE = 0.5
#: Bins a unit of the logarithm of the odds.
BINS = 512
NULL_SOURCE = "\u0000null"


def _keys(i: str, t: str, s: str) -> dict[str, Column]:
    who = F.coalesce(F.col(i).cast("string"), F.lit("null"))
    u = (F.conv(F.substring(F.md5(who), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))
    return {
        "m_source": F.coalesce(F.col(s).cast("string"), F.lit(NULL_SOURCE)),
        "m_size": F.sqrt(F.coalesce(F.length(t), F.lit(0)) + F.lit(1.0)),
        "m_odds": u / (1 - u),
        "m_id": F.coalesce(F.col(i).cast("bigint"), F.lit(-(2**63))),
        "m_text": F.xxhash64(t),
    }


def _shares(rows: DataFrame, weights: dict[str, float] | None, temperature: float, budget: int | None) -> DataFrame:
    """(s_source, s_size, s_share): one row a source."""
    per = saved(rows.groupBy("m_source").agg(F.count("*").alias("n"), F.sum("m_size").alias("size")), "sources")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (NULL_SOURCE if k is None else k, float(v))])
        weight = F.coalesce(given[F.col("m_source")], F.lit(0.0))
    total = per.agg(F.sum(weight).alias("w"), F.sum("n").alias("all")).first()
    exact = F.col("weight") / F.lit(total["w"]) * F.lit(total["all"] if budget is None else budget)
    part = per.withColumn("weight", weight).withColumn("exact", F.coalesce(exact, F.lit(0.0)))
    part = part.withColumn("low", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("low"), 9))
    spare = part.agg((F.round(F.sum("exact")) - F.sum("low")).cast("long")).first()[0] or 0
    part = numbered(part, F.desc("rest"), F.asc("m_source"))
    return part.select(
        F.col("m_source").alias("s_source"), F.col("size").alias("s_size"),
        (F.col("low") + (F.col("place") <= spare).cast("long")).alias("s_share"),
    )


def _expected(rows: DataFrame, shares: DataFrame) -> DataFrame:
    e = F.round(F.col("s_share") * F.col("m_size") / F.col("s_size"), 9)
    out = rows.join(shares, F.col("m_source") == F.col("s_source")).withColumn("m_e", e).withColumn("m_whole", F.floor("m_e"))
    f = F.col("m_e") - F.col("m_whole")
    return out.withColumn("m_q", F.when(f > 0, F.col("m_odds") * ((1 - f) / f)))


def _plan(keys: DataFrame, weights, temperature, budget) -> DataFrame:
    """A row a source: its size, share and rank limit; l_take of the l_rows rows alike that
    lie on the limit are drawn."""
    shares = saved(_shares(keys, weights, temperature, budget), "shares")
    drawn = _expected(keys, small_side(shares, "shares")).withColumn("bin", F.floor(F.ln("m_q") * BINS))
    counts = saved(drawn.groupBy("m_source", "bin").agg(F.count("*").alias("n"), F.sum("m_whole").alias("whole"), F.first("s_share").alias("share")), "bins")
    need = counts.groupBy("m_source").agg((F.first("share") - F.sum("whole")).alias("need"))
    below = F.sum("n").over(Window.partitionBy("m_source").orderBy("bin"))  # some thousand bins a source
    at = counts.where("bin is not null").join(need, "m_source").withColumn("upto", below)
    at = at.where("need > 0 and upto >= need and upto - n < need").select(F.col("m_source").alias("b_source"), F.col("bin").alias("b_bin"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
    alike = drawn.join(small_side(at, "limits"), (F.col("m_source") == F.col("b_source")) & (F.col("bin") == F.col("b_bin"))).groupBy("m_source", "m_q", "m_id", "m_text").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    upto = F.sum("n").over(Window.partitionBy("m_source").orderBy("m_q", "m_id", "m_text"))
    limit = (
        alike.withColumn("upto", upto)
        .where("upto >= left and upto - n < left")
        .select(F.col("m_source").alias("l_source"), F.col("m_q").alias("l_q"), F.col("m_id").alias("l_id"), F.col("m_text").alias("l_text"), F.col("n").alias("l_rows"), F.expr("left - upto + n").alias("l_take"))
    )
    # a source that needs more extra copies than it has fractions (rounding) takes all of them
    short = counts.where("bin is not null").groupBy("m_source").agg(F.sum("n").alias("have")).join(need, "m_source").where("need > have").select(F.col("m_source").alias("o_source"))
    return (
        shares.join(limit, F.col("s_source") == F.col("l_source"), "left")
        .join(short, F.col("s_source") == F.col("o_source"), "left")
        .select("s_source", "s_size", "s_share", "l_q", "l_id", "l_text", "l_rows", "l_take", F.col("o_source").isNotNull().alias("l_all"))
    )


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with keys) drawn at least once, and m_copies."""
    drawn = _expected(rows, plan)
    same = F.col("m_q") == F.col("l_q")
    under = (F.col("m_q") < F.col("l_q")) | (same & (F.col("m_id") < F.col("l_id"))) | (same & (F.col("m_id") == F.col("l_id")) & (F.col("m_text") < F.col("l_text")))
    on = F.coalesce(same & (F.col("m_id") == F.col("l_id")) & (F.col("m_text") == F.col("l_text")), F.lit(False))
    extra = F.coalesce(under | (F.col("l_all") & F.col("m_q").isNotNull()), F.lit(False))
    counted = lambda df, more: df.withColumn("m_copies", (F.col("m_whole") + more.cast("long")).cast("int")).where("m_copies > 0")
    if plan.where("l_rows > l_take").isEmpty():
        return counted(drawn, extra | on)
    split = on & (F.col("l_rows") > F.col("l_take"))
    # rows alike on a limit: numbered by the task that read them and their place in it
    some = saved(drawn.where(split).withColumn("m_row", F.monotonically_increasing_id()), "alike")
    some = some.withColumn("m_task", F.shiftright("m_row", 33))
    sizes = some.groupBy("s_source", "m_task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s_source").orderBy("m_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = small_side(sizes.select(F.col("s_source").alias("t_source"), F.col("m_task").alias("t_task"), before.alias("t_before")), "starts")
    place = F.row_number().over(Window.partitionBy("s_source", "m_task").orderBy("m_row")) + F.col("t_before")
    placed = some.join(starts, (F.col("s_source") == F.col("t_source")) & (F.col("m_task") == F.col("t_task"))).withColumn("m_place", place)
    more = counted(placed, F.col("m_place") <= F.col("l_take"))
    return counted(drawn.where(~split), extra | on).unionByName(more.select(*drawn.columns, "m_copies"))


def allocate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: int | None = None) -> DataFrame:
    """(doc_id, source, expected, copies) of every document drawn at least once. Without
    ``weights`` a source weighs (its documents)^temperature; without ``budget`` as many
    rows are drawn as there are."""
    rows, (i, t, s) = plain(docs, id_col, text, source)
    keys = saved(rows.select(i, s, *[c.alias(k) for k, c in _keys(i, t, s).items()]), "keys")
    got = _copies(keys, small_side(_plan(keys, weights, temperature, budget), "mix"))
    return got.select(F.col(i).alias("doc_id"), F.col(s).alias("source"), F.round("m_e", 6).alias("expected"), F.col("m_copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it was drawn, all columns as they were."""
    rows, (i, t, s) = plain(docs, id_col, text, source)
    keys = saved(rows.select(*[c.alias(k) for k, c in _keys(i, t, s).items()]), "keys")
    got = _copies(rows.withColumns(_keys(i, t, s)), small_side(_plan(keys, weights, temperature, budget), "mix"))
    return got.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*rows.columns).toDF(*docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s, sqrt(coalesce(length(text), 0) + 1.0::DOUBLE) AS size,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(2**52)!r}::DOUBLE AS u FROM documents),
per AS (SELECT s, count(*) AS n, sum(size) AS total FROM d GROUP BY s),
x AS (SELECT *, pow(n::DOUBLE, 0.5::DOUBLE) / sum(pow(n::DOUBLE, 0.5::DOUBLE)) OVER () * sum(n) OVER () AS exact FROM per),
y AS (SELECT *, floor(exact) AS low, round(exact - floor(exact), 9) AS rest FROM x),
z AS (SELECT s, total, (low + (row_number() OVER (ORDER BY rest DESC, s) <= round(sum(exact) OVER ()) - sum(low) OVER ())::INT)::BIGINT AS share FROM y),
e AS (SELECT doc_id, source, d.s, u, share, round(share * size / total, 9) AS e FROM d JOIN z ON d.s = z.s),
f AS (SELECT *, floor(e) AS whole, e - floor(e) AS f FROM e),
g AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) * ((1 - f) / f) END AS q, share - sum(whole) OVER (PARTITION BY s) AS need FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY q NULLS LAST, doc_id) AS place FROM g)
SELECT doc_id, source, round(e, 6) AS expected, (whole + (q IS NOT NULL AND place <= need)::INT)::INT AS copies FROM r
WHERE whole + (q IS NOT NULL AND place <= need)::INT > 0
"""
