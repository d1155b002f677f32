"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.plans.tables import owned

#: A word: anything between the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset in local mode (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of rows that go to a Python worker at once: texts can be long, so a number of rows alone bounds nothing.
BATCH_BYTES, BATCH_OPTION = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, and any executor can be lost. It lasts
    as long as the workspace around (coderake.plans.tables), if there is one."""
    spark = df.sparkSession
    path = owned(f"{shared_dir(spark)}/coderake/{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(BATCH_OPTION, None)
    spark.conf.set(BATCH_OPTION, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_OPTION, before) if before is not None else spark.conf.unset(BATCH_OPTION)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column ``name``: each row's place, from 0, in this order. Rows are sorted in ranges, and each range begins
    where the ones before it end, so no task sees all rows; only the ranges' sizes come to the driver."""
    ranges = saved(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias(name)), "ordered")
    part, place = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    start, starts = 0, {}
    for row in sorted(ranges.groupBy(part.alias("part")).count().collect()):
        starts[row["part"]], start = start, start + row["count"]
    begin = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), part) if starts else F.lit(0)
    return ranges.withColumn(name, begin + place)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a null id counts as empty text); rows with 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def hash_share(share: float, *cols: Column, seed: int = 0) -> Column:
    """True for about this share of rows, always the same ones."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


#: Bytes of text whose results a task holds at once, about.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PART_BYTES of text each (column number ``text``), whatever the number of rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) + 64 * np.arange(len(sizes))) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def tidy(scan):
    """A scan for mapInArrow that gives Arrow's unused memory back at its end: Python workers go on to serve other tasks,
    and what each of them keeps (some 100 MB) would add up beside the executor's own memory."""
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def tidy_groups(work):
    """The same for functions of groups."""
    def run(*tables):
        try:
            return work(*tables)
        finally:
            pa.default_memory_pool().release_unused()

    # Spark tells functions of groups apart by their parameters.
    return (lambda left, right: run(left, right)) if work.__code__.co_argcount == 2 else (lambda table: run(table))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has such a column already, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
