"""Interval joins: equal chromosome and coordinate bin, the overlap test on top.

An interval is dealt to the bins it touches; a pair is kept in the bin where the later of the two starts, so it comes once. A hot
chromosome is spread over its bins, and AQE splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binned import totals
from .islands import BLOCK, merge

BIN = 1 << 14


def _binned(df: DataFrame, width: int) -> DataFrame:
    last = F.greatest(F.col("initial"), F.col("final") - 1)
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("initial") / width), F.floor(last / width))))


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, on: Column | None = None) -> DataFrame:
    """Pairs of overlapping rows; b's columns get the prefix b_. on: a further condition over both."""
    right = _binned(b, width)
    right = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    same = (F.col("chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("b__bin"))
    over = (F.col("initial") < F.col("b_final")) & (F.col("b_initial") < F.col("final"))
    once = F.col("_bin") == F.floor(F.greatest("initial", "b_initial") / width)
    where = same & over & once if on is None else same & over & once & on
    return _binned(a, width).join(right, where).drop("_bin", "b__bin")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pieces common to the merged sides."""
    return overlap_join(merge(a), merge(b)).select("chrom", F.greatest("initial", "b_initial").alias("initial"), F.least("final", "b_final").alias("final"))


def semi(a: DataFrame, b: DataFrame, anti: bool = False) -> DataFrame:
    """Rows of a that overlap any row of b (or none). Rows at the same place share their answer, so no row id is needed; overlaps are
    counted by sums over starts and ends, not paired."""
    place = ["chrom", "initial", "final"]
    hit = totals(a, b, tuple(place), {"_n": None}).select(*place)
    return a.join(hit, place, "left_anti" if anti else "left_semi")


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a inside a row of b, once for each container."""
    inside = (F.col("initial") >= F.col("b_initial")) & (F.col("final") <= F.col("b_final"))
    return overlap_join(a, b.select("chrom", "initial", "final"), on=inside)


def gaps(b: DataFrame, span: DataFrame) -> DataFrame:
    """(chrom, initial, final): what b leaves free of each chromosome's span (chrom, lo, hi).

    The piece before a piece is looked up inside its block of coordinates; what crosses blocks is one row for each block, so a chromosome
    is never one task."""
    pieces = merge(b).select("chrom", "initial", "final").withColumn("_block", F.floor(F.col("initial") / BLOCK))
    inside = F.lag("final").over(Window.partitionBy("chrom", "_block").orderBy("initial"))
    earlier = F.max("_top").over(Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carry = pieces.groupBy("chrom", "_block").agg(F.max("final").alias("_top")).select("chrom", "_block", earlier.alias("_carry"))
    before = pieces.withColumn("_own", inside).join(carry, ["chrom", "_block"]).join(span, "chrom")
    inner = before.select("chrom", F.coalesce("_own", "_carry", "lo").alias("i"), F.col("initial").alias("f"))
    last = carry.groupBy("chrom").agg(F.max("_block").alias("_block")).join(pieces, ["chrom", "_block"]).groupBy("chrom").agg(F.max("final").alias("_top"))
    tail = span.join(last, "chrom", "left").select("chrom", F.coalesce("_top", "lo").alias("i"), F.col("hi").alias("f"))
    return inner.union(tail).filter("i < f").select("chrom", F.col("i").alias("initial"), F.col("f").alias("final"))


def span(a: DataFrame) -> DataFrame:
    """(chrom, lo, hi): from the first to the last position of a's rows."""
    return a.groupBy("chrom").agg(F.min("initial").alias("lo"), F.max("final").alias("hi"))


def outside(a: DataFrame, b: DataFrame, *keep: str) -> DataFrame:
    """(keep, chrom, initial, final): the pieces of each row of a that b doesn't cover. Columns keep of a are taken along."""
    met = overlap_join(a.select("chrom", "initial", "final", *keep), gaps(b, span(a)))
    return met.select(*keep, "chrom", F.greatest("initial", "b_initial").alias("initial"), F.least("final", "b_final").alias("final"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the merged a has outside b."""
    return outside(merge(a), b)


def complement(a: DataFrame, sizes: DataFrame) -> DataFrame:
    """The parts of each chromosome (chrom, length) outside a."""
    return subtract(sizes.select("chrom", F.lit(0).cast("bigint").alias("initial"), F.col("length").alias("final")), a)
