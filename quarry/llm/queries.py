"""The operators over their whole tables, with production parameters, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, packing, pii, quality, secrets, simhash, suffix, topk, toxicity, warc
from quarry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": lambda s, d: topk.search(table(s, d, "embeddings")),
    "op2_quality_rules": lambda s, d: quality.assess(table(s, d, "documents")),
    "op3_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op4_secret_scan": lambda s, d: secrets.scan_documents(table(s, d, "documents")),
    "op5_pii": lambda s, d: pii.extract(table(s, d, "documents")),
    "op6_suffix_dedup": lambda s, d: suffix.repeated_passages(table(s, d, "documents")),
    "op7_simhash": lambda s, d: simhash.groups(table(s, d, "documents")),
    "op8_toxicity": lambda s, d: toxicity.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op9_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.allocate(table(s, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": topk.SQL,
    "op2_quality_rules": quality.SQL,
    "op3_warc": warc.SQL,
    "op4_secret_scan": secrets.SQL,
    "op6_suffix_dedup": suffix.SQL,
    "op10_mixing": mixing.SQL,
}
