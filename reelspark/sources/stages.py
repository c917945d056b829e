"""Stage tables: cut a long plan by a table written to the cluster's shared folder.

A result reads the stage tables of its plan, so they stay until their owner lets go: inside `with stages(spark):` every table that is
written belongs to the block and goes with it. Write the result out before the block ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("stages", default=None)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Owns the paths and tables made inside: both are deleted at its end, after an error, too."""
    paths, tables = made = ([], [])
    before = _owner.set(made)
    try:
        yield
    finally:
        _owner.reset(before)
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a temporary folder, but only in a local session (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-reel-"))
        base = sc.getCheckpointDir()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    if owner := _owner.get():
        owner[0].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table. Spark takes the size of its compressed files for that of its rows, and would broadcast tables that are many times
    larger in memory: its joins are merges."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def bucketed_stage(df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
    """As stage(), with the rows of equal keys in one bucket, so that joins on these keys need not shuffle them. The table's files
    lie in the shared folder, too; the session's catalog knows it by a name of its own."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    if owner := _owner.get():
        owner[1].append(table)
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
