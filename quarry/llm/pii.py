r"""Personal identifiers by bootstrapped contextual extraction.

Candidates are the maximal mail-like, telephone-like and digit-bearing spans of a text.
Seed entities are those that a strict validator of a type accepts (or given ones). They
induce lexical patterns, four a mention: the span's exact shape; its coarse shape with
the word before; its coarse shape with the word after; the words before and after it,
whatever its shape. Patterns and instances (distinct spans) form a bipartite graph, scored
in ``rounds`` rounds for each type:

    conf(p)  = sum of vouch(i, p) over the instances i of p / (instances of p + 1)
    vouch    = 1 for a seed, else the greatest conf(q) >= ``accept`` among i's patterns q
               of a kind that shares nothing with p's (:data:`APART`), else 0
    score(i) = 1 for a seed, else the greatest conf(p) >= ``accept`` among all i's patterns

A pattern needs ``support`` instances, one without a shape ``context_support``.

so patterns that seeds mostly fill pull in identifiers no validator knows (numbers that
fail a check digit, or are written as none expects), and their new instances raise
patterns of other kinds. An instance never vouches for the kind of pattern that found it,
so a pattern can't lift itself: a shape that seeds and look-alikes share stays at the
seeds' part of it. Instances with a score are identifiers, of the type of greatest score
(ties: the first by name). :func:`redact` replaces mentions where they stand; the same
characters elsewhere in a text, inside a longer word say, are left.

Defined cases: null and empty texts have no mention; a null doc_id is carried through;
repeated rows give their mentions each, instances count once; extra columns are kept by
:func:`redact` under any names and ignored by :func:`extract`; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import plain, saved, small_side

CANDIDATE = (
    r"[\p{L}\d._%+\-]+@[\p{L}\d\-]+(?:\.[\p{L}\d\-]+)+"
    r"|(?:\+\d{1,3}[ .\-]?)?\(\d{2,5}\)[ .\-]?\d+(?:[ .\-]\d+)*"
    r"|(?<![\p{L}\d])\d{4}(?: \d{4}){3}(?![\p{L}\d])|(?<![\p{L}\d])\d{4} \d{6} \d{5}(?![\p{L}\d])"
    r"|(?<![\p{L}\d])\+?\p{L}*+\d[\p{L}\d]*+(?:[.\-/:]\p{L}*+\d[\p{L}\d]*+)*+"
)
ROUNDS, SUPPORT, CONTEXT_SUPPORT, ACCEPT = 5, 3, 6, 0.75
#: Kinds of patterns, by the first letter: shape, left word, right word, context of both.
KINDS = ("s", "l", "r", "c")
#: The kinds whose patterns may vouch for one of the kind.
APART = {"s": ("l", "r", "c"), "l": ("s", "r"), "r": ("s", "l"), "c": ("s",)}


def seed_rules(value: Column) -> dict[str, Column]:
    digits = F.regexp_replace(value, r"\D", "")
    octets = F.split(value, r"\.")
    return {
        "card": value.rlike(r"^(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})$") & F.call_function("luhn_check", digits),
        "email": value.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"),
        "ip": value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.coalesce(F.array_max(F.transform(octets, lambda x: x.try_cast("int"))) <= 255, F.lit(False)),
        "phone": value.rlike(r"^\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}$"),
        "ssn": value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"),
    }


TYPES = ("card", "email", "ip", "phone", "ssn")


def fine_shape(value: Column) -> Column:
    """Letter runs as a, runs of 1 to 3 digits as d, longer ones by their length; names of
    any number of parts alike in mail addresses."""
    s = F.regexp_replace(value, r"\p{L}+", "a")
    s = F.when(s.contains("@"), F.regexp_replace(F.regexp_replace(s, r"[a\d._%+\-]+@", "m@"), r"@[a\d.\-]+", "@h")).otherwise(s)
    for n in range(19, 3, -1):
        s = F.regexp_replace(s, rf"(?<!\d)\d{{{n}}}(?!\d)", f"<{chr(96 + n)}>")
    return F.regexp_replace(F.regexp_replace(s, r"\d{20,}", "<long>"), r"\d+", "d")


def coarse_shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\d+", "d")


def candidates(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` columns, mention (its place in the text), value, left and right words."""
    some = docs.where(F.col(text).rlike(r"[\d@]"))
    found = some.select(*keep, F.col(text).alias("q_text"), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("q_values"))
    # the pieces between the candidates hold each one's neighbours
    found = found.withColumn("q_between", F.split("q_text", CANDIDATE)).drop("q_text")
    kept = [c for c in found.columns if not c.startswith("q_")]
    each = found.select(*kept, "q_between", F.posexplode("q_values").alias("mention", "value"))
    last = F.lower(F.regexp_extract(F.get("q_between", F.col("mention")), r"(\p{L}+)[^\p{L}]*$", 1))
    first = F.lower(F.regexp_extract(F.get("q_between", F.col("mention") + 1), r"^[^\p{L}]*(\p{L}+)", 1))
    return each.select(*kept, "mention", "value", last.alias("left"), first.alias("right"))


def scores(mentions: DataFrame, seeds: DataFrame | None = None, rounds: int = ROUNDS, support: int = SUPPORT, context_support: int = CONTEXT_SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(value, pii_type, score, seeded) of accepted instances. ``mentions`` has value, left
    and right; ``seeds`` (value, pii_type) adds to the validators."""
    value = F.col("value")
    patterns = F.array(
        F.concat(F.lit("s "), fine_shape(value)),
        F.when(F.col("left") != "", F.concat(F.lit("l "), coarse_shape(value), F.lit(" "), F.col("left"))),
        F.when(F.col("right") != "", F.concat(F.lit("r "), coarse_shape(value), F.lit(" "), F.col("right"))),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("c "), F.col("left"), F.lit(" "), F.col("right"))),
    )
    edges = mentions.select("value", F.explode(F.array_compact(patterns)).alias("pattern")).distinct()
    edges = saved(edges, "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("pattern").startswith("c "), context_support).otherwise(support))
    edges = saved(edges.join(sizes, "pattern"), "edges")
    values = mentions.select("value").distinct()
    tests = seed_rules(value)
    valid = F.array_compact(F.array(*[F.when(tests[t], F.lit(t)) for t in TYPES]))
    seeded = values.select("value", F.explode(valid).alias("pii_type"))
    if seeds is not None:
        seeded = seeded.unionByName(values.join(seeds.select("value", "pii_type"), "value"))
    seeded = saved(seeded.distinct(), "seeds")
    kind = F.substring("pattern", 1, 1)
    known = seeded.select("value", "pii_type", *[F.lit(1.0).alias(k) for k in KINDS])
    score = known
    for _ in range(rounds):
        # the greatest score by a pattern of a kind apart; a seed has 1 of every kind
        vouch = F.greatest(*[F.when(kind.isin([a for a in KINDS if k in APART[a]]), F.col(k)) for k in KINDS])
        conf = edges.join(score, "value").groupBy("pattern", "pii_type").agg((F.sum(vouch) / (F.first("n") + 1.0)).alias("conf")).where(F.col("conf") >= accept)
        found = edges.join(conf, "pattern").groupBy("value", "pii_type").agg(*[F.coalesce(F.max(F.when(kind == k, F.col("conf"))), F.lit(0.0)).alias(k) for k in KINDS])
        score = saved(found.unionByName(known).groupBy("value", "pii_type").agg(*[F.max(k).alias(k) for k in KINDS]), "scores")
    score = score.select("value", "pii_type", F.greatest(*KINDS).alias("score"))
    best = score.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("k"), "pii_type", "score")).alias("b")).select("value", "b.pii_type", "b.score")
    return best.join(seeded.withColumn("s", F.lit(True)), ["value", "pii_type"], "left").select("value", "pii_type", F.round("score", 6).alias("score"), F.coalesce("s", F.lit(False)).alias("seeded"))


def extract(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seeds: DataFrame | None = None, **how) -> DataFrame:
    """(doc_id, mention, pii_type, value, score, seeded) of every identifier in every text."""
    rows, (i, t) = plain(docs, id_col, text)
    mentions = saved(candidates(rows, t, F.col(i).alias("doc_id")), "mentions")
    return mentions.join(scores(mentions, seeds, **how), "value").select("doc_id", "mention", "pii_type", "value", "score", "seeded")


def redact(docs: DataFrame, text: str = "text", count: str | None = "n_chars", seeds: DataFrame | None = None, **how) -> DataFrame:
    """``docs`` with identifiers replaced by [TYPE] in ``text`` (and, if there is such a
    column, ``count`` set to the new length where a text changed); other columns and all
    rows stay."""
    rows, (t,) = plain(docs, text)
    n = plain(docs, count)[1][0] if count is not None and count.lower() in map(str.lower, docs.columns) else None
    mentions = saved(candidates(rows, t, F.md5(t).alias("key")), "mentions")
    mark = F.struct("mention", F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")))
    # the mentions of one text, however many rows hold it
    found = mentions.join(scores(mentions, seeds, **how), "value").select("key", "mention", "pii_type").distinct()
    per = small_side(found.groupBy(F.col("key").alias("p_key")).agg(F.map_from_entries(F.collect_list(mark)).alias("p_marks")), "found", 4 << 20, "shuffle_hash")
    maybe = F.coalesce(F.col(t).rlike(r"[\d@]"), F.lit(False))
    values = F.transform(F.regexp_extract_all(F.col(t), F.lit(CANDIDATE), F.lit(0)), lambda x, k: F.coalesce(F.try_element_at("p_marks", k), x))
    woven = F.transform(F.arrays_zip(F.split(t, CANDIDATE).alias("between"), values.alias("value")), lambda x: F.concat(x["between"], F.coalesce(x["value"], F.lit(""))))
    hit = rows.where(maybe).withColumn("p_text_key", F.md5(t)).join(per, F.col("p_text_key") == F.col("p_key"), "left")
    hit = hit.withColumn("p_new", F.when(F.col("p_marks").isNotNull(), F.array_join(woven, "")))
    out = []
    for c in rows.columns:
        if c == t:
            out.append(F.coalesce("p_new", c).alias(c))
        elif c == n:
            out.append(F.coalesce(F.length("p_new").cast(rows.schema[c].dataType), c).alias(c))
        else:
            out.append(F.col(c))
    return rows.where(~maybe).unionByName(hit.select(*out)).toDF(*docs.columns)
