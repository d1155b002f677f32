"""Scanning files as they arrive: the operators of a file keep no state between files, so a stream of files gives a stream
of findings; counts come with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coderake.plans.scan import scan
from coderake.plans.tables import workspace
from coderake.sources.files import plain_path

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    from pyspark.sql import functions as F

    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    return stream.select(plain_path(F.col("path")).alias("path"), "content", F.col("length").alias("size"))


def scan_stream(files: DataFrame, out: str, checkpoint: str, **options):
    """Starts a query that writes each micro-batch's findings and summary as Parquet under out, once per batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # What a micro-batch writes for itself goes with it.
        with workspace(batch.sparkSession):
            done = scan(batch, **options)
            done.found.write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
            done.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={batch_id}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
