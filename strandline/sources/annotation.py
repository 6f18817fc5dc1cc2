"""Text formats of annotation, models and experiments to DataFrames, and result formats back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = ("tf_id", "name", "version", "gene_names", "class", "uniprot", "source", "tax_group", "species", "thresholds")


def _at(i: int) -> Column:
    return F.get("p", F.lit(i))


def _split(spark: SparkSession, path: str, by: str = "\t") -> DataFrame:
    line = F.trim("value") if by != "\t" else F.col("value")
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split(line, by).alias("p"))


def read_sizes(spark: SparkSession, path: str, x: bool = True, y: bool = True, m: bool = True) -> DataFrame:
    """(chrom, length); contigs named random or with an underscore are left out, X, Y and M on request."""
    rows = _split(spark, path, r"\s+").select(_at(0).alias("chrom"), _at(1).try_cast("bigint").alias("length")).filter("length IS NOT NULL")
    rows = rows.filter(~F.col("chrom").contains("random") & ~F.col("chrom").contains("_"))
    for keep, letter in ((x, "X"), (y, "Y"), (m, "M")):
        rows = rows if keep else rows.filter(~F.col("chrom").contains(letter))
    return rows


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, symbol, alias): one row for each alias, the symbol and the id among them, aliases in upper case."""
    rows = _split(spark, path).select(_at(0).alias("gene_id"), _at(1).alias("symbol"), F.coalesce(_at(2), F.lit("")).alias("more"))
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array("gene_id", "symbol"), F.split("more", "&")), F.upper), lambda v: v.isNotNull() & (v != "")))
    return rows.select("gene_id", "symbol", F.explode(every).alias("alias"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene, value): a header or other line without a number is left out; the version is cut from ids that start with EN."""
    gene = F.upper(_at(0))
    rows = _split(spark, path, r"\s+").select(F.when(gene.startswith("EN"), F.substring_index(gene, ".", 1)).otherwise(gene).alias("gene"), _at(1).try_cast("double").alias("value"))
    return rows.filter("value IS NOT NULL")


def read_motif_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each motif; gene names and UniProt ids as arrays, thresholds as doubles. Missing columns are null."""
    rows = _split(spark, path).select(*(F.nullif(F.trim(_at(i)), F.lit("")).alias(c) for i, c in enumerate(METADATA)))
    numbers = F.transform(F.split("thresholds", ","), lambda v: v.try_cast("double"))
    return rows.withColumns({"gene_names": F.split("gene_names", r"\+"), "uniprot": F.split("uniprot", ";"), "thresholds": numbers})


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(name, counts): one motif a file, named after it; rows of counts in order A, C, G, T."""
    text = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    numbers = lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.try_cast("double"))
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.pwm$", "")
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.pwm").select(name.alias("name"), F.transform(text, numbers).alias("counts"))


def read_triplexes(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """Triplex hits of 12 columns or more: rna, rna_i, rna_f (moved by shift), chrom, initial, final (on the chromosome when the DNA
    name is chrom:start-end), score, error_rate, motif, strand, orientation. Mitochondrial hits are left out."""
    number = lambda i, kind="bigint": _at(i).try_cast(kind)
    where = r"^([^:]+):(\d+)-(\d+)"
    base = F.coalesce(F.regexp_extract(_at(3), where, 2).try_cast("bigint"), F.lit(0))
    chrom = F.coalesce(F.nullif(F.regexp_extract(_at(3), where, 1), F.lit("")), _at(3))
    rows = _split(spark, path).filter(F.size("p") >= 12)
    out = rows.select(_at(0).alias("rna"), (number(1) + shift).alias("rna_i"), (number(2) + shift).alias("rna_f"), chrom.alias("chrom"), (base + number(4)).alias("initial"), (base + number(5)).alias("final"), number(6, "double").alias("score"), number(7, "double").alias("error_rate"), _at(9).alias("motif"), _at(10).alias("strand"), _at(11).alias("orientation"))
    return out.filter("initial IS NOT NULL AND final IS NOT NULL AND rna_i IS NOT NULL AND rna_f IS NOT NULL AND chrom <> 'chrM'")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, file, factor, value): one row for each value of each further column. Lines of fewer than three fields are left
    out; a relative file is taken from BASE_DIR, if the table names one. The header may stand anywhere before the rows it names."""
    rows = _split(spark, path, r"\s+").filter(F.size("p") >= 2)
    head = rows.filter(F.array_contains("p", "name") & F.array_contains("p", "type") & F.array_contains("p", "file")).limit(1).select(F.col("p").alias("head"))
    base = rows.filter(_at(0).startswith("BASE_DIR")).agg(F.first(_at(1), ignorenulls=True).alias("base"))
    body = rows.filter((F.size("p") >= 3) & ~_at(0).startswith("BASE_DIR") & ~(F.array_contains("p", "name") & F.array_contains("p", "type")))
    named = body.join(F.broadcast(head)).join(F.broadcast(base)).withColumn("m", F.map_from_arrays("head", F.transform("head", lambda h, i: F.get("p", i))))  # a header and a folder: one row each
    file = F.col("m")["file"]
    full = F.when(F.col("base").isNull() | file.startswith("/"), file).otherwise(F.concat(F.regexp_replace("base", "/$", ""), F.lit("/"), file))
    factors = F.filter(F.map_entries("m"), lambda e: ~e["key"].isin("name", "type", "file") & e["value"].isNotNull())
    out = named.select(F.col("m")["name"].alias("name"), F.col("m")["type"].alias("type"), full.alias("file"), F.explode_outer(factors).alias("e"))
    return out.select("name", "type", "file", F.col("e.key").alias("factor"), F.explode_outer(F.split("e.value", ",")).alias("value"))


def expand_all(experiments: DataFrame) -> DataFrame:
    """Rows whose value is ALL repeated for each other value of their factor."""
    other = experiments.filter("value <> 'ALL'").select("factor", F.col("value").alias("_v")).distinct()
    wide = experiments.filter("value = 'ALL'").join(other, "factor").withColumn("value", F.col("_v")).select(*experiments.columns)
    return experiments.filter("value IS NULL OR value <> 'ALL'").unionByName(wide)


def paired(experiments: DataFrame, reference: str, query: str) -> DataFrame:
    """(factor, value, reference, query): files of two types that share a factor's value."""
    side = lambda t, c: experiments.filter(F.col("type") == t).select("factor", "value", F.col("name").alias(c))
    return side(reference, "reference").join(side(query, "query"), ["factor", "value"])


def write_wig(df: DataFrame, path: str, span: int, zeros: bool = False) -> None:
    """Bins (chrom, initial, value) as variableStep, positions from 1, a file for each chromosome; zero bins only if asked for."""
    rows = df if zeros else df.filter("value <> 0")
    rows = rows.select("chrom", F.col("initial").alias("_at"), F.concat_ws(" ", (F.col("initial") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    head = rows.select("chrom").distinct().select("chrom", F.lit(-1).cast("bigint").alias("_at"), F.format_string(f"variableStep chrom=%s span={span}", "chrom").alias("value"))
    rows.unionByName(head).withColumn("of", F.col("chrom")).repartition("of").sortWithinPartitions("of", "_at").select("of", "value").write.mode("overwrite").partitionBy("of").text(path)


def write_narrow_peaks(df: DataFrame, path: str) -> None:
    """Peaks (chrom, initial, final, orientation, x, y, p) in ten columns; p is -log10 already, the summit is unknown."""
    name = F.concat(F.lit("peak_"), F.xxhash64("chrom", "initial", "final", "orientation").cast("string"))
    ratio = F.round((F.col("x") + 1) / (F.col("y") + 1), 4)
    score = F.least(F.round(F.col("p") * 10), F.lit(1000)).cast("int")
    cells = ["chrom", "initial", "final", name, score, "orientation", ratio, F.round("p", 4), F.lit("-1"), F.lit("-1")]
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells)).alias("value")).write.mode("overwrite").text(path)
