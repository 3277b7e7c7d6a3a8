"""A corpus pipeline of five operators, each stage working on what the one before kept.

1. quality rules: documents that fail, or whose host is rejected, go;
2. SimHash near-dedup: one document of each group stays;
3. personal identifiers are replaced by [TYPE] in the text;
4. sources are mixed to target weights: rows are dropped or repeated;
5. the rows are packed into sequences; the last stage returns each piece's text, and the
   sequence, place and copy that it has.

Null, empty, repeated and clashing input is treated as each operator's docstring says; an
empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, packing, pii, quality, simhash
from quarry.llm.common import discard, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.keep_good(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.keep_one(docs)),
    ("pii", lambda spark, docs, sf_dir: pii.redact(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_texts(docs)),
]

#: SimHash groups are components of a relation that SQL can't express within reason; the
#: pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{k}-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
