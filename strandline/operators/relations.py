"""Relations between interval sets: what overlaps first, signed distances, remnants, runs of equal labels, triplex hits.

Rows carry a unique _ord. All joins are binned equi-joins, see joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binned import first_row, strictly_inside, totals
from .islands import BLOCK, merge, with_islands
from .joins import outside, overlap_join

PLACE = ("chrom", "initial", "final")


def first_overlapping(a: DataFrame, b: DataFrame, col: str, out: str) -> DataFrame:
    """a with out: col of the overlapping row of b that sorts first, null where there is none."""
    return first_row(a, b, col, out)


def overlap_flag(a: DataFrame, b: DataFrame, out: str = "hit") -> DataFrame:
    """a with out: Y where a row of b overlaps, else N."""
    hit = totals(a, b, PLACE, {"_n": None}).select(*PLACE).withColumn(out, F.lit("Y"))
    return a.join(hit, list(PLACE), "left").fillna("N", [out])


def overlapping_names(a: DataFrame, b: DataFrame, same_strand: bool | None = None, sep: str = ",") -> DataFrame:
    """(_ord, names): sorted names of overlapping rows of b, of the same strand (True), the other (False) or any (None)."""
    on = None if same_strand is None else (F.col("orientation") == F.col("b_orientation")) == F.lit(same_strand)
    hit = overlap_join(a.select("_ord", *PLACE, "orientation"), b.select(*PLACE, "orientation", "name"), on=on)
    return hit.groupBy("_ord").agg(F.array_join(F.array_sort(F.collect_list("b_name")), sep).alias("names"))


def gap(i: Column, f: Column, b_i: Column, b_f: Column) -> Column:
    """Positions between two intervals of a chromosome, 0 if they overlap or touch."""
    return F.greatest(b_i - f, i - b_f, F.lit(0))


def position_code(i: Column, f: Column, b_i: Column, b_f: Column) -> Column:
    """-1 if the first lies before the second, 1 if after it, 0 if they overlap."""
    return F.when(f <= b_i, -1).when(i >= b_f, 1).otherwise(0)


def remnants(a: DataFrame, b: DataFrame) -> DataFrame:
    """(_ord, chrom, initial, final): what each row of a has outside b; rows of a aren't merged."""
    return outside(a, b, "_ord")


def cut_keep_end(a: DataFrame, b: DataFrame, upstream: bool = True) -> DataFrame:
    """(_ord, chrom, initial, final): of each row's remnants the one at its upstream or downstream end along its strand."""
    rest = remnants(a, b).join(a.select("_ord", "orientation"), "_ord")
    first = (F.col("orientation") == "+") == F.lit(upstream)
    return rest.groupBy("_ord", "chrom", "orientation").agg(F.min(F.struct("initial", "final")).alias("lo"), F.max(F.struct("initial", "final")).alias("hi")).select("_ord", "chrom", F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("p")).select("_ord", "chrom", "p.initial", "p.final")


def with_runs(df: DataFrame, label: str, block: int = BLOCK) -> DataFrame:
    """df with _run, numbered by chrom: rows next to each other in order of start with an equal label. What crosses blocks of
    coordinates is the last label of each block and the number of runs before it."""
    order = ("initial", "final", "_ord", label)
    rows = df.withColumn("_block", F.floor(F.col("initial") / block))
    by_block, inside = Window.partitionBy("chrom").orderBy("_block"), Window.partitionBy("chrom", "_block").orderBy(*order)
    last = rows.groupBy("chrom", "_block").agg(F.max(F.struct(*order)).alias("m")).select("chrom", "_block", F.lag(f"m.{label}").over(by_block).alias("_before"))
    marked = rows.join(last, ["chrom", "_block"]).withColumn("_new", F.when(F.coalesce(F.lag(label).over(inside), F.col("_before")).eqNullSafe(F.col(label)), 0).otherwise(1))
    base = marked.groupBy("chrom", "_block").agg(F.sum("_new").alias("_n")).select("chrom", "_block", F.coalesce(F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return marked.join(base, ["chrom", "_block"]).withColumn("_run", F.col("_base") + F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_block", "_before", "_new", "_base")


def merge_adjacent(df: DataFrame, label: str) -> DataFrame:
    """(chrom, label, initial, final, n): overlapping rows merged, a change of label in sort order breaks them."""
    return merge(with_runs(df, label), 0, ("chrom", label, "_run")).drop("_run")


def self_overlap(df: DataFrame) -> DataFrame:
    """(chrom, overlaps): whether any rows of the chromosome overlap one another, and n_inside, rows less islands."""
    per = merge(df).groupBy("chrom").agg(F.max("n").alias("top"), F.sum(F.col("n") - 1).alias("n_inside"))
    return per.select("chrom", (F.col("top") > 1).alias("overlaps"), "n_inside")


def merge_rna_sites(hits: DataFrame) -> DataFrame:
    """Triplex hits (rna_i, rna_f, DNA place) by merged RNA site: rna_i, rna_f, n hits, n_places distinct DNA places.
    Every hit lies in one island of its own RNA, so numbering rows replaces a join."""
    rows = hits.select("_ord", F.lit("rna").alias("chrom"), F.col("rna_i").alias("initial"), F.col("rna_f").alias("final"), F.struct(*PLACE).alias("dna"))
    return with_islands(rows, 0, ("chrom",), 64).groupBy("_island").agg(F.min("initial").alias("rna_i"), F.max("final").alias("rna_f"), F.count(F.lit(1)).alias("n"), F.countDistinct("dna").alias("n_places")).drop("_island")


def cis_class(chrom: Column, i: Column, f: Column, locus: tuple[str, int, int], near: int = 10_000) -> Column:
    """trans on another chromosome, cis beyond near from the RNA's locus, else local; distance 0 is local."""
    name, start, end = locus
    return F.when(chrom != name, "trans").when(gap(i, f, F.lit(start), F.lit(end)) > near, "cis").otherwise("local")


def partitions(sets: list[DataFrame], key: str) -> DataFrame:
    """(mask, n): how many keys lie in exactly the sets of mask, bit j for set j."""
    parts = [s.select(key).distinct().withColumn("bit", F.lit(1 << j)) for j, s in enumerate(sets)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("bit").cast("bigint").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def tss(genes: DataFrame, end: bool = False) -> DataFrame:
    """One-position start (or end) sites along the strand, merged."""
    left = (F.col("orientation") == "+") != F.lit(end)
    return merge(genes.withColumns({"initial": F.when(left, F.col("initial")).otherwise(F.col("final") - 1), "final": F.when(left, F.col("initial") + 1).otherwise(F.col("final"))}))


def pairs_inside(reads: DataFrame, regions: DataFrame, pair: str) -> DataFrame:
    """(pair): pairs of one forward and one reverse read on a chromosome that lie strictly inside one region from end to end."""
    ends = reads.groupBy(pair, "chrom").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("orientation").alias("o"), F.min("initial").alias("initial"), F.max("final").alias("final")).filter("c = 2 AND o = 2")
    return strictly_inside(ends.select(pair, *PLACE), regions).select(pair).distinct()
