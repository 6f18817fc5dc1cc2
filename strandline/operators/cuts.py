"""Cut sites of reads: pile-ups, signal clean-up as array expressions, and k-mer bias.

A forward read cuts at its start plus a shift, a reverse one before its end plus another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmer_counts
from .joins import overlap_join


def cut_sites(reads: DataFrame, forward: int = 0, reverse: int = 0) -> DataFrame:
    """reads as intervals of one position, where they cut."""
    at = F.when(F.col("orientation") == "-", F.col("final") + reverse - 1).otherwise(F.col("initial") + forward)
    return reads.withColumn("initial", at).withColumn("final", F.col("initial") + 1)


def pileup(regions: DataFrame, cuts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(_ord, by, offset, n): cuts at each position of each region, positions without cuts left out. Cuts are intervals of one position; those
    at one place are counted before they meet the regions, so a hot place is a row, and a region and a place are a row of the result. Bins
    are narrow, since most of what meets in one is tested in vain."""
    per = cuts.groupBy("chrom", "initial", *by).agg(F.count(F.lit(1)).alias("n")).withColumn("final", F.col("initial") + 1)
    met = overlap_join(regions.select("_ord", "chrom", "initial", "final"), per, 256)
    return met.select("_ord", *(F.col(f"b_{c}").alias(c) for c in by), (F.col("b_initial") - F.col("initial")).alias("offset"), F.col("b_n").alias("n"))


def dense(regions: DataFrame, piled: DataFrame) -> DataFrame:
    """(_ord, signal): the pile-up of each region as an array over all its positions, zeros included. A region's array is as long as it is."""
    pairs = piled.groupBy("_ord").agg(F.map_from_entries(F.collect_list(F.struct("offset", "n"))).alias("at"))
    size = (F.col("final") - F.col("initial")).cast("int")
    places = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    signal = F.transform(places, lambda i: F.coalesce(F.try_element_at("at", i.cast("bigint")), F.lit(0)).cast("double"))
    return regions.select("_ord", "initial", "final").join(pairs, "_ord", "left").select("_ord", F.when(size > 0, F.when(F.col("at").isNull(), F.transform(places, lambda i: F.lit(0.0))).otherwise(signal)).otherwise(F.array().cast("array<double>")).alias("signal"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, not anew for each entry of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _moments(y: Column) -> Column:
    """Mean and standard deviation of an array, null where it is empty."""
    spread = lambda mean: F.struct(mean.alias("mean"), F.sqrt(F.try_divide(F.aggregate(y, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), F.size(y))).alias("sd"))
    return let(F.try_divide(_sum(y), F.size(y)), spread)


def clipped(x: Column, most: float, sds: float = 10.0) -> Column:
    """Entries cut off at most, then at their mean and so many standard deviations."""
    first = F.transform(x, lambda v: F.least(v, F.lit(float(most))))
    return let(first, lambda y: let(_moments(y), lambda m: F.transform(y, lambda v: F.least(v, m["mean"] + sds * m["sd"]))))


def percentile(x: Column, q: float) -> Column:
    """The q-th percentile of an array, with a straight line between neighbours."""

    def of(y: Column) -> Column:
        at = (F.size(y) - 1) * q / 100
        low = F.floor(at).cast("int")
        a, b = F.get(y, low), F.get(y, F.least(low + 1, F.size(y) - 1))
        return a + (b - a) * (at - low)

    return let(F.sort_array(x), of)


def between_sets(x: Column, q: float, fixed: Column | None = None, signed: bool = False) -> Column:
    """Logistic of the distance from the q-th percentile (or a fixed value) in standard deviations of the entries; zeros stay, and so does an
    array without spread. signed: a negative entry becomes what its size would, with a minus sign; otherwise it is taken as it is."""

    def of(y: Column) -> Column:
        at = F.struct((percentile(y, q) if fixed is None else fixed).alias("middle"), _moments(y)["sd"].alias("sd"))
        squash = lambda m: F.when(m["sd"] > 0, F.transform(y, lambda v: F.when(v == 0, 0.0).when(F.lit(signed) & (v < 0), -1 / (1 + F.exp(-(-v - m["middle"]) / m["sd"]))).otherwise(1 / (1 + F.exp(-(v - m["middle"]) / m["sd"]))))).otherwise(y)
        return let(at, squash)

    return let(x, of)


def masked_mean(x: Column, window: int = 5, rank: int = 4) -> Column:
    """Centred means over window entries, the rank greatest entries (ties: earliest first) left out; null where none is left."""
    order = F.slice(F.sort_array(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, rank)

    def of(top: Column) -> Column:
        keep = F.transform(x, lambda v, i: F.when(~F.array_contains(F.transform(top, lambda t: t["i"]), i), v))
        part = lambda y, i: F.filter(F.slice(y, F.greatest(i + 1 - window // 2, F.lit(1)), F.least(i, F.lit(window // 2)) + 1 + window // 2), lambda v: v.isNotNull())
        mean = lambda y: F.when(F.size(y) > 0, _sum(y) / F.size(y))
        smooth = lambda y: F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda i: mean(part(y, i)))
        return let(keep, smooth)

    return F.when(F.size(x) > 0, let(order, of)).otherwise(x)


def kmer_bias(cuts: DataFrame, sequences: DataFrame, key: str, k: int, most: int = 100) -> DataFrame:
    """(orientation, kmer, observed, expected, bias) for all k-mers of A, C, G, T that stand in the sequences: cuts (key, orientation, position)
    by the k-mer around them, at most so many at one place and strand, against all k-mers of the sequences; one is added to every count, and
    bias is the ratio of the shares. Sequences (key, seq) are cut into k-mers phase by phase, in time linear in their length; only k-mers and
    their counts are shuffled."""
    half, word = k // 2, "^[ACGT]+$"
    places = cuts.groupBy(key, "orientation", "position").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    at = places.join(sequences, key).withColumn("kmer", F.substr("seq", (F.col("position") - half + 1).cast("int"), F.lit(k)))
    seen = at.filter((F.col("position") >= half) & (F.length("kmer") == k) & F.col("kmer").rlike(word)).groupBy("orientation", "kmer").agg(F.sum("n").alias("n"))
    every = kmer_counts(sequences.filter(F.length("seq") >= k), k).filter(F.col("kmer").rlike(word)).withColumnRenamed("n", "all")
    both = every.select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("orientation")).join(seen, ["orientation", "kmer"], "left").select("orientation", "kmer", (F.coalesce("n", F.lit(0)) + 1).alias("observed"), (F.col("all") + 1).alias("expected"))
    total = both.groupBy("orientation").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e"))
    return both.join(total, "orientation").select("orientation", "kmer", "observed", "expected", ((F.col("observed") / F.col("o")) / (F.col("expected") / F.col("e"))).alias("bias"))
