"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, secret scans, best-fit packing.

Each stage works on all that the one before kept. run() writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import best_fit_packing, line_dedup, minhash_dedup, quality_rules, secret_scan
from strandline.llm.store import Shelf, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stand within their group's fences."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more cut out; n_chars follows the text."""
    return _counted(docs, line_dedup.line_dedup_filter(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.near_dedup_filter(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; n_chars follows the text."""
    return _counted(docs, secret_scan.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a sequence."""
    return best_fit_packing.pack_documents(docs, best_fit_packing.word_count(F.col("text")), best_fit_packing.text_cluster(F.col("text")))


def _counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: Quantile sketches, winnowing and best-fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return docs
