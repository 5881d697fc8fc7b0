"""Where jobs keep tables between steps: a folder that the driver and every executor share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Under these settings what a query shuffled is deleted when it ends, not when the driver next collects garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A task that writes one bucket need not sort its rows by bucket first.
_UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": "2"}
#: Rows of a kept table that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    named = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    made = getattr(spark.sparkContext, "_heddle_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext._heddle_shared = made
    return made


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_heddle_paths", []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that this session has kept, once no result that reads them is needed; the number deleted."""
    paths = spark.sparkContext.__dict__.pop("_heddle_paths", [])
    for table in spark.sparkContext.__dict__.pop("_heddle_tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is planned inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``materialise`` in so many of Spark's buckets by ``key``: joins and groups by it read the table where it lies."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with settings(spark, _UNSORTED):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    spark.sparkContext.__dict__.setdefault("_heddle_tables", []).append(table)
    return spark.table(table)


def few(df: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is a kept table of few rows."""
    return F.broadcast(df) if df.count() <= at_most else df
