"""Training-corpus pipeline: STAGES run in order over `documents`, each over all that the one before kept.

Each stage's result is written as Parquet and read again as the next one's
documents. All stages but the last keep the columns of documents; the last
returns the mix, a row per document with the words that it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import decontamination, line_dedup, mixing, quality_classifier, simhash
from sessionlake.llm.scratch import scratch_path

ACCEPT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; null and empty texts are scored too, repeated rows alike."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_accepted(docs, model, ACCEPT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents that have nothing else; null and empty texts stay as they are, repeated rows are one document."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the least doc_id, one row of it; rows without an id come last."""
    return simhash.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages; rows without an id are one document."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a null source is one of them, each repeated row is a row of the mix."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mixture", mixture)]

#: A trained classifier and fingerprints decide which rows there are; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of `sf_dir`. A stage's table goes when the next one is written, the last when the application ends."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        last = path
    return docs
