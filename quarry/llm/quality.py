"""Host-level quality rules with an empirical beta prior.

Each document is tested by rules on its whole text. Failures are summed by host (the
``source`` column), every (host, rule) rate is shrunk towards the corpus by a beta prior
fitted to the hosts themselves by moments, and a host with a shrunk rate above
``host_limit`` under any rule is rejected. The verdict is joined back: a document is kept
when it passes every rule and its host is not rejected.

Defined cases: a null or blank text fails ``empty`` alone; a null host is a host of its
own; repeated rows count and are returned each; columns beyond id, text and host are
ignored by :func:`assess` and kept by :func:`keep_good`, under any names; an empty table
gives an empty result; with fewer than two hosts, or hosts that don't differ, the prior is
Beta(m, 1 - m) of the corpus rate m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain, saved, small_side

RULES = ("empty", "symbols", "shouting", "tables", "repeats", "dup_lines", "word_length")
SYMBOLS = r"[#$%&*!|~^<>{}=]"
HOST_LIMIT = 0.5


def rule_columns(text: Column) -> dict[str, Column]:
    """One boolean a rule, true where the text fails it; never null."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    kept = lambda others: F.length(F.regexp_replace(text, others, ""))  # noqa: E731  runs go at once
    words = F.regexp_count(text, F.lit(r"\S+"))
    letters = kept(r"\P{L}+")
    lines = F.split(text, "\n")
    again = F.regexp_count(text, F.lit(r"(?<!\S)(\S++)(?=\s+\1(?!\S))"))
    some = words > 0
    return {
        "empty": ~some,
        "symbols": some & (chars - kept(SYMBOLS) > 0.04 * chars),
        "shouting": some & (letters >= 20) & (kept(r"\P{Lu}+") > 0.5 * letters),
        "tables": some & (chars - F.length(F.replace(text, F.lit("|"), F.lit(""))) > 0.2 * words),
        "repeats": some & (words >= 10) & (again > 0.2 * words),
        "dup_lines": some & (F.size(lines) >= 4) & (F.size(F.array_distinct(lines)) < 0.5 * F.size(lines)),
        "word_length": some & (kept(r"\s+") > 30 * words),
    }


def host_verdicts(failed: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(q_host, q_docs, q_rate, q_reject): q_rate is the largest shrunk rate of a host."""
    counts = failed.groupBy("q_host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"q_{r}").cast("long")).alias(r) for r in RULES])
    long = counts.select("q_host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("f")) for r in RULES])).alias("x")).select("q_host", "n", "x.rule", "x.f")
    rate = F.col("f") / F.col("n")
    prior = long.groupBy("rule").agg((F.sum("f") / F.sum("n")).alias("m"), F.avg(rate).alias("mu"), F.var_samp(rate).alias("v"))
    usable = (F.col("v") > 0) & (F.col("mu") > 0) & (F.col("mu") < 1) & (F.col("mu") * (1 - F.col("mu")) > F.col("v"))
    prior = prior.select(
        F.col("rule").alias("p_rule"),
        F.when(usable, F.col("mu")).otherwise(F.col("m")).alias("center"),
        F.when(usable, F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1).otherwise(F.lit(1.0)).alias("strength"),
    )
    shrunk = (F.col("f") + F.col("center") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return (
        long.join(F.broadcast(prior), F.col("rule") == F.col("p_rule"))  # one row a rule
        .groupBy("q_host")
        .agg(F.first("n").alias("q_docs"), F.round(F.max(shrunk), 6).alias("q_rate"))
        .withColumn("q_reject", F.col("q_rate") > host_limit)
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, host, failed, host_rate, host_rejected, kept), a row for each document."""
    rows, (i, t, h) = plain(docs, id_col, text, host)
    flags = [c.alias(f"q_{r}") for r, c in rule_columns(F.col(t)).items()]
    failed = saved(rows.select(F.col(i).alias("q_id"), F.col(h).alias("q_host"), *flags), "quality")
    verdicts = small_side(host_verdicts(failed, host_limit).select(F.col("q_host").alias("v_host"), "q_rate", "q_reject"), "hosts")
    names = F.concat_ws(",", *[F.when(F.col(f"q_{r}"), F.lit(r)) for r in RULES])
    return failed.join(verdicts, F.col("q_host").eqNullSafe(F.col("v_host")), "left").select(
        F.col("q_id").alias("doc_id"), F.col("q_host").alias("host"), names.alias("failed"),
        F.col("q_rate").alias("host_rate"), F.col("q_reject").alias("host_rejected"), ((names == "") & ~F.col("q_reject")).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, all columns as they were. The rules
    run once: rows and flags are written, and no text is shuffled."""
    rows, (t, h) = plain(docs, text, host)
    marked = saved(rows.select("*", *[c.alias(f"q_{r}") for r, c in rule_columns(F.col(t)).items()]), "marked")
    counted = marked.select(F.col(h).alias("q_host"), *[f"q_{r}" for r in RULES])
    verdicts = small_side(host_verdicts(counted, host_limit).where("q_reject").select(F.col("q_host").alias("v_host")), "hosts")
    good = marked.where(" and ".join(f"not q_{r}" for r in RULES))
    return good.join(verdicts, good[h].eqNullSafe(F.col("v_host")), "left_anti").select(*rows.columns).toDF(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, length(x) AS c, regexp_extract_all(x, '\S+') AS ws, string_split(x, chr(10)) AS ls,
  length(x) - length(regexp_replace(x, '\p{L}', '', 'g')) AS letters,
  length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS upper_,
  length(x) - length(regexp_replace(x, '[#$%&*!|~^<>{}=]', '', 'g')) AS sym,
  length(x) - length(replace(x, '|', '')) AS pipes,
  length(x) - length(regexp_replace(x, '\S', '', 'g')) AS solid FROM t),
f AS (SELECT doc_id, host, len(ws) = 0 AS empty_,
  len(ws) > 0 AND sym > 0.04 * c AS symbols,
  len(ws) > 0 AND letters >= 20 AND upper_ > 0.5 * letters AS shouting,
  len(ws) > 0 AND pipes > 0.2 * len(ws) AS tables_,
  len(ws) >= 10 AND len(list_filter(list_zip(ws[1:-2], ws[2:]), lambda p: p[1] = p[2])) > 0.2 * len(ws) AS repeats,
  len(ws) > 0 AND len(ls) >= 4 AND len(list_distinct(ls)) < 0.5 * len(ls) AS dup_lines,
  len(ws) > 0 AND solid > 30 * len(ws) AS word_length FROM w),
c AS (SELECT host, count(*) AS n, unnest(['empty', 'symbols', 'shouting', 'tables', 'repeats', 'dup_lines', 'word_length']) AS rule,
  unnest([sum(empty_::INT), sum(symbols::INT), sum(shouting::INT), sum(tables_::INT), sum(repeats::INT), sum(dup_lines::INT), sum(word_length::INT)]) AS bad
  FROM f GROUP BY host),
p AS (SELECT rule, sum(bad) / sum(n) AS m, avg(bad / n) AS mu, var_samp(bad / n) AS v FROM c GROUP BY rule),
q AS (SELECT rule, CASE WHEN ok THEN mu ELSE m END AS center, CASE WHEN ok THEN mu * (1 - mu) / v - 1 ELSE 1 END AS strength
  FROM (SELECT *, coalesce(v > 0 AND mu > 0 AND mu < 1 AND mu * (1 - mu) > v, false) AS ok FROM p)),
h AS (SELECT host, round(max((bad + center * strength) / (n + strength)), 6) AS host_rate FROM c JOIN q USING (rule) GROUP BY host)
SELECT doc_id, f.host AS host,
  concat_ws(',', CASE WHEN empty_ THEN 'empty' END, CASE WHEN symbols THEN 'symbols' END, CASE WHEN shouting THEN 'shouting' END,
    CASE WHEN tables_ THEN 'tables' END, CASE WHEN repeats THEN 'repeats' END, CASE WHEN dup_lines THEN 'dup_lines' END,
    CASE WHEN word_length THEN 'word_length' END) AS failed,
  host_rate, host_rate > 0.5 AS host_rejected,
  NOT (empty_ OR symbols OR shouting OR tables_ OR repeats OR dup_lines OR word_length) AND NOT host_rate > 0.5 AS kept
FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host
"""
