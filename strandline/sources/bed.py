"""BED text to intervals and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, initial, final, name, score, orientation). Inverted ends are swapped; lines without three parsable fields, and
    zero-length ones, are left out."""
    part = F.split(F.trim("value"), r"\s+")
    get = lambda i: F.get(part, F.lit(i))
    a, b = get(1).try_cast("bigint"), get(2).try_cast("bigint")
    rows = spark.read.text(path).select(get(0).alias("chrom"), F.least(a, b).alias("initial"), F.greatest(a, b).alias("final"), get(3).alias("name"), get(4).try_cast("double").alias("score"), get(5).alias("orientation"), (a.isNull() | b.isNull()).alias("_bad"))
    return rows.filter(~F.col("_bad") & (F.col("initial") != F.col("final"))).drop("_bad")


def write_bed(df: DataFrame, path: str) -> None:
    """Six columns; a missing name is chrom:initial-final, a missing score or strand a dot."""
    name = F.coalesce(F.col("name"), F.format_string("%s:%d-%d", "chrom", "initial", "final"))
    df.select(F.concat_ws("\t", "chrom", F.col("initial").cast("string"), F.col("final").cast("string"), name, F.coalesce(F.col("score").cast("string"), F.lit(".")), F.coalesce("orientation", F.lit("."))).alias("value")).write.mode("overwrite").text(path)
