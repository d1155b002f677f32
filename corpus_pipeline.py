"""A training corpus from raw documents: quality, language, near copies, mixture, packing.

Every stage but the last returns the columns of its input, whatever else these are: columns that a stage makes for
itself get names that its input does not have. A row is a document of its own, also where it repeats another row or
an id; a null id is an id like any other. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.llm.common import BATCH_BYTES, BATCH_OPTION, free_name, saved
from coderake.llm.langid import label as label_language
from coderake.llm.langid import train as train_language
from coderake.llm.mixing import cyclic_weights, mixed_documents
from coderake.llm.ngram_join import near_duplicates
from coderake.llm.packing import pack_documents
from coderake.llm.quality import score as score_quality
from coderake.llm.quality import train as train_quality


def _session(spark: SparkSession) -> None:
    """Texts can be long: what goes to a Python worker at once is bounded by bytes in this job's session, unless it is so
    already. A stage's result is written by its caller, so the setting has to stay."""
    if spark.conf.get(BATCH_OPTION, None) is None:
        spark.conf.set(BATCH_OPTION, BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for good (a score of 0.5 or more); the model learns from the labels of
    this input. A null text is scored as an empty one. Without any labels every score is 0.5, and all stay."""
    _session(spark)
    model = train_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    own = free_name(docs, "quality_score")
    return score_quality(docs, model, own).where(F.col(own) >= 0.5).drop(own)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is told clearly: not those without letters (null and empty texts among them),
    nor ambiguous ones. The model learns from the input's own lang; without any, nothing is told and nothing stays."""
    _session(spark)
    model = train_language(docs.select("doc_id", "text", "lang"))
    names = free_name(docs, "language_found"), free_name(docs, "language_score"), free_name(docs, "language_unclear")
    return label_language(docs, model, names=names).where((F.col(names[0]) != "und") & ~F.col(names[2])).drop(*names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id, null last; of rows with one id the first as
    written. Rows without words are no copies of each other and all stay."""
    _session(spark)
    key = free_name(docs, "row_key")
    rows = saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key")).alias("row"), "text")
    kept = near_duplicates(named, id_col="row").where("component_id = doc_id").select(F.col("doc_id.key").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: whole passes over documents, and the words of blocks drawn once more. A null source is a source;
    a text without words has nothing that could be taken."""
    return mixed_documents(docs, cyclic_weights(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in which training sequence. A null text is empty."""
    _session(spark)
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("language identification", language), ("n-gram Jaccard join", deduplicate), ("mixing sources", mixture), ("best-fit packing", packing)]

#: Classifiers, a seeded mix and a packing have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
