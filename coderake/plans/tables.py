"""Relations that several branches of a plan read, written once."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What names of tables in the catalog begin with.
PREFIX = "coderake_"
#: What the innermost workspace of each thread owns: (name, path), or nothing outside of one.
_OWNED = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset in local mode (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: A task writes its bucket as the rows come, without a sort of them by bucket first: that begins once as many files are open as
#: this says, so two leave a task with one bucket alone (with one, all rows but the first are sorted). And rows that tasks
#: read by bucket stay so, also where no window or join of the plan needs that.
_BUCKETED = {"spark.sql.maxConcurrentOutputFileWriters": "2", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def _set(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: plans that use it stay small, and any executor can be lost. by: a column
    by which df's rows are dealt out in ``parts`` (or as many as spark.sql.shuffle.partitions); the table remembers that, so
    windows and groups by it (and more), and joins with other tables of so many parts, shuffle nothing. Such a table has an
    entry in the session's catalog until release(). In a workspace a table lasts as long as that."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = owned(f"{shared_dir(spark)}/coderake/{own}", PREFIX + own)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that are dealt out by path meet others by path and token where they are. This stays set in the session, as plans
    # over the table are made later; it changes where rows go, and no result.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    with _set(spark, _BUCKETED):
        df.write.bucketBy(parts, by).format("parquet").option("path", path).saveAsTable(PREFIX + own)
    return spark.table(PREFIX + own)


def owned(path: str, name: str | None = None) -> str:
    """path, which the workspace around, if there is one, clears at its end, and the table of that name."""
    if getattr(_OWNED, "tables", None) is not None:
        _OWNED.tables.append((name, path))
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is written for plans in this block, by this thread, is for the block alone: at its end, also where it fails, the
    tables leave the catalog and their files the shared folder. DataFrames over them are of no use afterwards, so write
    or count what is to last. Workspaces may stand in each other, each clears its own, and what was written outside of them or by
    others stays. A driver that is lost clears nothing."""
    around, _OWNED.tables = getattr(_OWNED, "tables", None), []
    try:
        yield
    finally:
        mine, _OWNED.tables = _OWNED.tables, around
        for name, path in mine:
            if name is not None:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Drops this library's entries from the session's catalog; files stay for whoever owns the shared folder."""
    for table in spark.catalog.listTables(pattern=f"{PREFIX}*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
