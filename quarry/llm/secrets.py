r"""Secret scanning over history with an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its bytes). The
ledger lists the rule versions that each blob was scanned with; only unseen pairs of blob
and rule version are scanned, each distinct blob once however many paths or versions hold
it, and findings, old and new, are joined back to all paths.

Contents stay where they are: what is shuffled are hashes. From those one row (path,
version) of each blob that has a rule due is chosen, and the contents are read again to
scan the chosen rows. The choice is broadcast, or what it leaves out is, whichever is small
by a check of its size; where neither is, rows are matched by a shuffle.

Defined cases: a null content has no blob and is skipped; an empty content is a blob
without findings; a null path or version is carried through; repeated rows give their
findings once a row; extra columns are ignored, under any names; an empty history gives no
findings and no ledger rows. Secrets are returned as SHA-256 only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, is_small, plain, saved, small_side


class Rule(NamedTuple):
    rule_id: str
    version: int
    pattern: str


#: Written in the syntax that Java's and RE2's expressions share.
RULES = (
    Rule("assigned_token", 2, r"(?:token|secret|password|passwd|api_?key|apikey|TOKEN|SECRET|PASSWORD|PASSWD|API_?KEY)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{16,}"),
    Rule("aws_access_key", 1, r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("github_token", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Rule("slack_token", 1, r"\bxox[abprs]-[A-Za-z0-9\-]{10,}"),
    Rule("google_key", 1, r"\bAIza[0-9A-Za-z_\-]{35}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("json_web_token", 1, r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*"),
)


#: The rules as they were when the history was first scanned: one was narrower, one lacked.
FIRST_RULES = (
    Rule("assigned_token", 1, r"(?:token|secret|password|api_key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{20,}"),
    *RULES[1:-1],
)


def _name(r: Rule) -> str:
    return f"{r.rule_id}:{r.version}"


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, content, due)."""
    each = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version"),
                 F.when(F.array_contains("due", _name(r)), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0))).alias("found"))
        for r in rules
    ])
    hit = F.filter(each, lambda x: F.size(x["found"]) > 0)
    new = texts.select("blob", F.explode(hit).alias("r")).select("blob", "r.rule_id", "r.rule_version", F.posexplode("r.found").alias("match_no", "secret"))
    # a chosen row that is repeated finds the same again
    return new.select("blob", "rule_id", "rule_version", "match_no", F.sha2("secret", 256).alias("secret_sha256")).distinct()


def _chosen(kept: DataFrame, where: DataFrame, blobs: DataFrame, limit: int) -> DataFrame:
    """(blob, content, due): one row of each blob with a rule due (and its repeats)."""
    here = (F.col("blob") == F.col("k_blob")) & F.struct("path", "version").eqNullSafe(F.col("k_at"))
    due = blobs.where(F.size("due") > 0)
    chosen = saved(due.select(F.col("blob").alias("k_blob"), F.col("at").alias("k_at"), "due"), "chosen")
    first = due.groupBy("due").count().orderBy(F.desc("count"), "due").first()
    if first is None or is_small(chosen, limit):
        return kept.join(F.broadcast(chosen), here).select("blob", "content", "due")
    # most rows are chosen, and most of them for the same rules: name the others
    usual = F.array(*[F.lit(x) for x in first["due"]])
    at = F.struct("path", "version")
    rest = where.join(blobs, "blob").where((F.size("due") == 0) | ~at.eqNullSafe(F.col("at"))).select(F.col("blob").alias("k_blob"), at.alias("k_at")).distinct()
    rest, other = saved(rest, "rest"), saved(due.where(F.col("due") != usual).select(F.col("blob").alias("o_blob"), "due"), "other")
    if is_small(rest, limit) and is_small(other, limit):
        texts = kept.join(F.broadcast(rest), here, "left_anti").join(F.broadcast(other), F.col("blob") == F.col("o_blob"), "left")
        return texts.select("blob", "content", F.coalesce("due", usual).alias("due"))
    return kept.join(chosen.hint("shuffle_hash"), here).select("blob", "content", "due")


def scan(history: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path", version: str = "version", content: str = "content", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, findings, ledger).

    findings: (blob, rule_id, rule_version, match_no, secret_sha256), old and new of the
    given rule versions; ledger: (blob, scanned), the rule:version names that a blob was
    scanned with, old and new; hits: the findings of each (path, version) of this history.
    Give the returned findings and ledger to the next call.
    """
    spark = history.sparkSession
    rows, (p, v, t) = plain(history, path, version, content)
    kept = rows.where(F.col(t).isNotNull()).select(F.col(p).alias("path"), F.col(v).alias("version"), F.col(t).alias("content"), F.sha2(t, 256).alias("blob"))
    where = saved(kept.select("path", "version", "blob"), "paths")
    names = F.array(*[F.lit(_name(r)) for r in rules])
    blobs = where.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is None:
        blobs = blobs.withColumn("due", names)
    else:
        old = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("scanned"))
        blobs = blobs.join(old, "blob", "left").withColumn("due", F.array_except(names, F.coalesce("scanned", F.array().cast("array<string>")))).drop("scanned")
    blobs = saved(blobs, "blobs")
    texts = _chosen(kept, where, blobs, limit)
    new = _matches(texts, rules)
    if findings is not None:
        known = spark.createDataFrame([tuple(r)[:2] for r in rules], "rule_id string, rule_version int")  # a row a rule
        new = new.unionByName(findings.join(F.broadcast(known), ["rule_id", "rule_version"], "left_semi").select(*new.columns))
    total = saved(new, "findings")
    book = blobs.where(F.size("due") > 0).select("blob", F.col("due").alias("scanned"))
    if ledger is not None:
        book = book.unionByName(ledger.select("blob", "scanned"))
    book = saved(book.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scanned")))).alias("scanned")), "ledger")
    hits = where.join(small_side(total, "hits"), "blob").select("path", "version", "blob", "rule_id", "rule_version", "match_no", "secret_sha256")
    return hits, total, book


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, path, rule_id, rule_version, match_no, secret_sha256): documents as a history
    in which each is the version doc_id of its source, scanned twice. The first round has
    the rules of then; the second has one of them in a new version and one that is new, and
    scans every blob with those two only; what the others found comes from the ledger."""
    rows, (i, t, s) = plain(docs, "doc_id", "text", "source")
    history = rows.select(F.col(s).alias("path"), F.col(i).alias("version"), F.col(t).alias("content"))
    _, findings, ledger = scan(history, rules=FIRST_RULES)
    hits, _, _ = scan(history, ledger, findings)
    return hits.select(F.col("version").alias("doc_id"), "path", "rule_id", "rule_version", "match_no", "secret_sha256")


SQL = (
    "WITH b AS (SELECT sha256(text) AS blob, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), m AS ("
    + " UNION ALL ".join(f"SELECT blob, '{r.rule_id}' AS rule_id, {r.version} AS rule_version, regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}') AS found FROM b" for r in RULES)
    + "), f AS (SELECT blob, rule_id, rule_version, unnest(range(len(found)))::INT AS match_no, unnest(found) AS secret FROM m)"
    " SELECT doc_id, source AS path, rule_id, rule_version, match_no, sha256(secret) AS secret_sha256"
    " FROM f JOIN documents d ON sha256(d.text) = f.blob"
)
