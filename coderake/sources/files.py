"""Source files as DataFrames: scanning, path predicates, language, decoding, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.functions.languages import BUILT_IN
from coderake.functions.vocabulary import IGNORED_PARTS, LANGUAGE_EXTENSIONS

#: What ends a line, as in universal line splitting.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def plain_path(path: Column) -> Column:
    """A file URI as a path."""
    return F.regexp_replace(path, r"^file:/+", "/")


def read_files(spark: SparkSession, root: str, max_file_bytes: int | None = None) -> DataFrame:
    """(path, content, size) of all regular files under root, or of root itself if it is a file. Filters on path and
    size reach the scan; with max_file_bytes larger files keep their row and have no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    content = F.col("content") if max_file_bytes is None else F.when(F.col("length") <= max_file_bytes, F.col("content"))
    return files.select(plain_path(F.col("path")).alias("path"), content.alias("content"), F.col("length").alias("size"))


def not_ignored(files: DataFrame, root: str | None = None, ignored: list[str] = IGNORED_PARTS) -> DataFrame:
    """Files none of whose path parts, its name included, is ignored. With root, parts of root do not count."""
    path = F.col("path") if root is None else F.regexp_replace("path", f"^{root.rstrip('/')}/", "")
    return files.where(~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in ignored])))


def with_language(files: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """Adds language by the last suffix, in lower case; files of no known language go."""
    known = extensions if extensions is not None else BUILT_IN.extensions(files.sparkSession)
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    # The dimension has a row for each suffix: small by nature.
    return files.withColumn("ext", suffix).join(F.broadcast(known), "ext").drop("ext")


def enabled_languages(files: DataFrame, languages: list[str] = tuple(LANGUAGE_EXTENSIONS)) -> DataFrame:
    return files.where(F.col("language").isin(*languages))


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def code_lines(files: DataFrame, *keys: str) -> DataFrame:
    """keys, line_no (from 1), line. A last line end begins no line; an empty text has none."""
    keys = keys or ("path", "language")
    parts = F.split("text", LINE_END)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    # Not posexplode: a filter on the array's size would be inferred, and each text split twice.
    rows = files.where(F.length("text") > 0).select(*keys, F.posexplode_outer(kept).alias("n", "line")).where("n IS NOT NULL")
    return rows.select(*keys, (F.col("n") + 1).alias("line_no"), "line")
