"""The folder that all executors share: where tables that cut lineage are written.

It is ``spark.checkpoint.dir``. Where that is unset a local session (tests, a shell) gets a
folder of its own; a cluster is refused, as a folder of one machine is not shared. All
tables of an application lie in one folder below it, deleted when the application ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import ConfigurationError

_OWN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
        _OWN[where] = spark
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own for a table or folder of this application."""
    home = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"
    _OWN.setdefault(home, spark)
    return f"{home}/{what}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where its files give fewer: what is
    costly to work out for a row is then shared out. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _OWN.items():
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # noqa: S110  the session is gone, and its files with it or left to its owner
            pass
