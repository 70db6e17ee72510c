"""A training corpus from ``documents``: language, near-duplicates, benchmark, mix, token ids.

Each stage works on what the one before it kept; all but the last return the
columns of the documents.  An empty table gives an empty table at every stage, and
extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apexline.llm import decontaminate, language, mixing, neardup, tokens
from apexline.llm.shared import kept

#: Rows and bytes that a Python worker gets at once: executors keep buffers of this size from stage to stage.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "2097152"}


def settled(spark: SparkSession) -> None:
    """The session's settings: documents may be long, so Python workers get few rows at once."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go, repeated rows stay as they are."""
    settled(spark)
    return language.known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest ``doc_id`` (null last); repeated rows become one, texts without words stay."""
    settled(spark)
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null and empty texts stay."""
    settled(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to twice; one without words stays by chance."""
    settled(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the file; a null or empty text is the end id alone."""
    settled(spark)
    return tokens.report(docs, chunk=1 << 18, remembered=50_000)


STAGES = [("language", known_language), ("near-duplicates", one_of_each), ("benchmark", without_benchmark), ("mix", mix), ("token ids", token_ids)]

#: Language scores, sketches, rounding by hash and subword ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(docs, name.replace(" ", "-"))
    return docs
