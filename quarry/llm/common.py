"""Helpers shared by the operators: reading tables, cutting lineage, safe column names,
size-checked joins, numbering and components."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.shared import drop, scratch

#: A side is broadcast only when it is written, counted and at most this large.
BROADCAST_BYTES = 16 << 20

WIDTHS = {"boolean": 1, "int": 4, "bigint": 8, "double": 8, "float": 4}

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and the
    result outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[got] = path
    return got


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`saved` wrote; nothing may read it any more."""
    for df in frames:
        if path := _WRITTEN.pop(df, None):
            drop(df.sparkSession, path)


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by place to c0, c1, ..., and what ``names`` are called
    there. No name of the caller's (dotted, quoted, twice the same, like one of ours) is
    looked up in a plan after this; ``toDF(*df.columns)`` gives them back."""

    def called(name: str) -> str:
        at = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"there is no column {name!r}; there are {', '.join(map(repr, df.columns))}")
        return f"c{at[0]}"

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [called(n) for n in names]


def is_small(kept: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table that :func:`saved` wrote may be broadcast: both what was written and
    rows x width stay within ``limit``."""
    spark, path = kept.sparkSession, _WRITTEN[kept]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    width = sum(WIDTHS.get(kind, 64) for _, kind in kept.dtypes)
    return size <= limit and kept.count() * width <= limit


def small_side(df: DataFrame, what: str = "side", limit: int = BROADCAST_BYTES, beyond: str | None = None) -> DataFrame:
    """``df`` written; broadcast where it :func:`is_small`, otherwise left to a shuffled join
    (with the hint ``beyond``)."""
    kept = saved(df, what)
    if is_small(kept, limit):
        return F.broadcast(kept)
    return kept.hint(beyond) if beyond else kept


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with a column ``name``: 1, 2, ... by ``order``, in many tasks. Rows are cut into
    ranges; each is numbered by itself, from the number of rows in the ranges before."""
    ranged = saved(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in ranged.groupBy("__range").count().collect())  # a row a range
    before, rows = [], 0
    for k, n in sizes:
        before.append((k, rows))
        rows += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__range int, __before long"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, own.cast("long")).join(starts, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): the least node of each connected component.

    Every round takes the least label among neighbours and then follows labels of
    labels (pointer jumping), so rounds grow with the logarithm of the diameter; each
    round is written to the shared folder, and the one before it deleted.
    """
    both = saved(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "edges",
    )
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        pulled = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        # the root of a root may have been lowered in the same round
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = saved(
            pulled.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was"),
            "labels",
        )
        discard(labels)
        labels = moved
        if moved.where("root <> was").isEmpty():
            discard(both)
            return labels.select("node", "root")
