"""Text formats of annotation and signals to DataFrames and back: GTF, FASTA, bedGraph, BED12, gene lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GTF = ("chrom", "source", "feature", "start", "end", "score", "orientation", "phase", "attributes")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))


def attribute(name: str, col: str = "attributes") -> Column:
    """Value of a GTF attribute, quoted or not; null where it is missing."""
    return F.nullif(F.regexp_extract(col, rf'(?:^|;)\s*{name}\s+"?([^";]+)"?', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, source: str | None = None, gene_type: str | None = None) -> DataFrame:
    """One row for each line of nine columns: place (start made 0-based), source, feature, strand, gene_id and transcript_id cut at
    their version, gene_name, gene_type. source and gene_type filter."""
    rows = _fields(spark, path).filter(F.size("p") == 9).select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(GTF)))
    cut = lambda c: F.substring_index(attribute(c), ".", 1).alias(c)
    out = rows.select("chrom", (F.col("start").try_cast("bigint") - 1).alias("initial"), F.col("end").try_cast("bigint").alias("final"), "source", "feature", "orientation", cut("gene_id"), cut("transcript_id"), attribute("gene_name").alias("gene_name"), attribute("gene_type").alias("gene_type"))
    out = out.filter("initial IS NOT NULL AND final IS NOT NULL")
    out = out if source is None else out.filter(F.upper("source") == source.upper())
    return out if gene_type is None else out.filter(F.col("gene_type") == gene_type)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, orientation, seq): seq in upper case without line ends; the strand comes from strand=- in the header, + by default."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>|\r", "").alias("r")).filter(F.trim("r") != "")
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace("r", r"^[^\n]*", "")
    return records.select(F.trim(head).alias("name"), F.when(head.rlike(r"strand=-"), "-").otherwise("+").alias("orientation"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def write_fasta(df: DataFrame, path: str) -> None:
    """Sequences wrapped at 80."""
    wrapped = F.regexp_replace("seq", "(.{80})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("name"), F.when(F.col("orientation") == "-", " strand=-").otherwise(""), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, initial, final, value); lines without exactly four columns or with unreadable numbers are left out."""
    at = lambda i: F.get("p", F.lit(i))
    rows = _fields(spark, path).filter(F.size("p") == 4).select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("initial"), at(2).try_cast("bigint").alias("final"), at(3).try_cast("double").alias("value"))
    return rows.dropna()


def write_bedgraph(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chrom", F.col("initial").cast("string"), F.col("final").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def bed12_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, initial, final, name, orientation): one row for each block of a BED12 line."""
    at = lambda i: F.get("p", F.lit(i))
    ints = lambda c: F.filter(F.transform(F.split(c, ","), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())
    rows = _fields(spark, path).filter(F.size("p") >= 12).select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("s"), at(3).alias("name"), at(5).alias("orientation"), F.explode(F.arrays_zip(ints(at(11)).alias("at"), ints(at(10)).alias("size"))).alias("b"))
    return rows.select("chrom", (F.col("s") + F.col("b.at")).alias("initial"), (F.col("s") + F.col("b.at") + F.col("b.size")).alias("final"), "name", "orientation")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, value): names in upper case, cut at the first dot or comma; an optional second column is the value."""
    part = F.split(F.trim("value"), r"\s+")
    gene = F.upper(F.regexp_extract(F.get(part, F.lit(0)), r"^[^.,]*", 0))
    return spark.read.text(path).select(gene.alias("gene"), F.get(part, F.lit(1)).try_cast("double").alias("value")).filter("gene <> ''")
