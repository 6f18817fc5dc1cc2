"""Result tables and models as text: BED12, gene lists, bias tables, enrichment tables and networks, models of Gaussian states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hmm import Model, gaussian
from ..operators.islands import merge


def write_bed12(df: DataFrame, path: str) -> None:
    """A line for each (chrom, name, orientation) with its merged rows as blocks. The blocks of one name are gathered in its line."""
    keys = ("chrom", "name", "orientation")
    blocks = merge(df, 0, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("initial", "final"))).alias("b"))
    first, last = F.col("b")[0]["initial"], F.element_at("b", -1)["final"]
    numbers = lambda f: F.array_join(F.transform("b", lambda x: f(x).cast("string")), ",")
    columns = ["chrom", first, last, "name", F.lit(0), "orientation", first, last, F.lit(0), F.size("b"), numbers(lambda x: x["final"] - x["initial"]), numbers(lambda x: x["initial"] - first)]
    df_out = blocks.select(F.concat_ws("\t", *(F.col(c) if isinstance(c, str) else c.cast("string") for c in columns)).alias("value"))
    df_out.write.mode("overwrite").text(path)


def write_genes(df: DataFrame, path: str) -> None:
    """A gene in a line, with its value if it has one."""
    df.select(F.concat_ws("\t", "gene", F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split("value", "\t").alias("p"), F.input_file_name().alias("file"))


def read_bias_table(spark: SparkSession, forward: str, reverse: str) -> DataFrame:
    """(orientation, kmer, bias) of two files, one for each strand."""
    one = lambda path, sign: _lines(spark, path).select(F.lit(sign).alias("orientation"), F.get("p", F.lit(0)).alias("kmer"), F.get("p", F.lit(1)).try_cast("double").alias("bias"))
    return one(forward, "+").unionByName(one(reverse, "-")).filter("bias IS NOT NULL")


def write_bias_table(df: DataFrame, path: str) -> None:
    """(orientation, kmer, bias) to a folder for each strand."""
    rows = df.select("orientation", F.concat_ws("\t", "kmer", F.col("bias").cast("string")).alias("value"))
    for sign, name in (("+", "F"), ("-", "R")):
        rows.filter(F.col("orientation") == sign).select("value").write.mode("overwrite").text(f"{path}/{name}")


def read_enrichment(spark: SparkSession, path: str, threshold: float = 1.0) -> DataFrame:
    """(condition, motif, p, genes): enrichment tables with a header line; the condition is the file's folder, p the third column, genes the tenth,
    null where p is above the threshold. Lines without a number in the third column are left out."""
    at = lambda i: F.get("p", F.lit(i))
    p = at(2).try_cast("double")
    rows = _lines(spark, path).select(F.element_at(F.split("file", "/"), -2).alias("condition"), at(0).alias("motif"), p.alias("v"), at(9).alias("genes"))
    return rows.filter("v IS NOT NULL").select("condition", "motif", F.col("v").alias("p"), F.when(F.col("v") <= threshold, F.split("genes", ",")).alias("genes"))


def enrichment_matrix(rows: DataFrame, conditions: list[str], threshold: float = 1.0) -> DataFrame:
    """(motif, a column for each condition): p of motifs that reach the threshold in any condition; 1 where a condition lacks one."""
    wide = rows.groupBy("motif").pivot("condition", conditions).agg(F.min("p"))
    return wide.fillna(1.0, conditions).filter(F.least(*(F.col(f"`{c}`") for c in conditions), F.lit(2.0)) <= threshold)


def network_edges(rows: DataFrame, motif_genes: DataFrame, targets: DataFrame) -> DataFrame:
    """(condition, factor, target, active): every edge from a factor (motif_genes: motif, gene) to a target (gene) that some condition has, for each
    condition, and whether that condition has it."""
    edges = rows.select("condition", "motif", F.explode("genes").alias("target")).join(motif_genes, "motif").select("condition", F.col("gene").alias("factor"), "target")
    kept = edges.join(targets.select(F.upper("gene").alias("_t")).distinct(), F.upper("target") == F.col("_t"), "left_semi").distinct()
    # Conditions are experiments, a handful; each edge is repeated for each of them.
    names = rows.agg(F.collect_set("condition").alias("all"))
    every = kept.select("factor", "target").distinct().crossJoin(names).select("factor", "target", F.explode("all").alias("condition"))  # one row
    return every.join(kept.withColumn("_has", F.lit(True)), ["condition", "factor", "target"], "left").select("condition", "factor", "target", F.coalesce("_has", F.lit(False)).alias("active"))


def read_model(lines: list[str]) -> Model:
    """A model of Gaussian states from the text form: a heading with the number of states, then under headings the start row, the rows of steps, and for
    each state means # covariances row by row. Headings are lines that don't begin with a number."""
    groups: list[list[str]] = []
    for line in filter(None, map(str.strip, lines)):
        if not (line[0].isdigit() or line[0] in "+-."):
            groups.append([])
        elif groups:
            groups[-1].append(line)
    numbers = lambda text: np.array([float(x) for x in text.split()])
    start, steps, states = [g for g in groups if g]
    params = []
    for line in states:
        mean, cov = map(numbers, line.split("#"))
        params.append((mean, cov.reshape(len(mean), len(mean))))
    return Model(numbers(start[0]), np.stack([numbers(x) for x in steps]), tuple(params), gaussian)


def model_lines(model: Model, digits: int = 6) -> list[str]:
    """The text form of a model of Gaussian states."""
    row = lambda values: " ".join(f"{v:.{digits}f}" for v in np.ravel(values))
    return [f"states {len(model.start)}", "initial", row(model.start), "transitions", *map(row, model.trans), "emissions", *(f"{row(m)} # {row(c)}" for m, c in model.params)]
