"""Signal operators: bins in long form, per-region arrays by higher-order functions, curves by block-wise running sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine_bins(a: DataFrame, b: DataFrame, subtract: bool = False) -> DataFrame:
    """(chrom, bin, value) of two signals added, or subtracted with negatives as 0; a bin missing on a side counts as 0."""
    both = a.join(b.withColumnRenamed("value", "b_value"), ["chrom", "bin"], "full").fillna(0, ["value", "b_value"])
    value = F.greatest(F.col("value") - F.col("b_value"), F.lit(0)) if subtract else F.col("value") + F.col("b_value")
    return both.select("chrom", "bin", value.alias("value"))


def per_million(df: DataFrame) -> DataFrame:
    """value divided by the signal's total in millions."""
    total = df.agg(F.sum("value").alias("_total"))
    return df.join(F.broadcast(total)).withColumn("value", F.col("value") / (F.col("_total") / 1e6)).drop("_total")  # one row


def stratum_norm(df: DataFrame, value: str, stratum: str) -> DataFrame:
    """value times the mean of all rows over the mean of the row's stratum; a stratum of mean 0 is left alone."""
    sums = df.groupBy(stratum).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    every = Window.partitionBy()  # one row for each stratum
    mean = sums.select(F.col(stratum).alias("_k"), (F.sum("_s").over(every) / F.sum("_c").over(every)).alias("_all"), (F.col("_s") / F.col("_c")).alias("_own"))
    return df.join(mean, F.col(stratum).eqNullSafe(F.col("_k")), "left").withColumn(value, F.when(F.col("_own") == 0, F.col(value)).otherwise(F.col(value) * F.col("_all") / F.col("_own"))).drop("_k", "_all", "_own")


def running(df: DataFrame, key: str, sums: list[str], width: float, desc: bool = True) -> DataFrame:
    """df, one row for each key, with running sums c_<sum> in order of key and totals t_<sum>. Blocks of key / width carry the sums
    before them, so a task holds one block."""
    rows = df.withColumn("_b", F.floor(F.col(key) / width))
    way = F.desc if desc else F.asc
    blocks = rows.groupBy("_b").agg(*(F.sum(s).alias(s) for s in sums))
    before, every = Window.orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = blocks.select("_b", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}") for s in sums), *(F.sum(s).over(every).alias(f"t_{s}") for s in sums))
    inside = Window.partitionBy("_b").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, "_b")
    return out.withColumns({f"c_{s}": F.col(f"_{s}") + F.sum(s).over(inside) for s in sums}).drop("_b", *(f"_{s}" for s in sums))


def curve(df: DataFrame, score: str, truth: Column, width: float) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision): what a cut at each distinct score, ties together, lets through."""
    each = df.groupBy(score).agg(F.sum(F.when(truth, 1).otherwise(0)).alias("p"), F.sum(F.when(truth, 0).otherwise(1)).alias("n"))
    c = running(each, score, ["p", "n"], width)
    tp, fp = F.col("c_p"), F.col("c_n")
    return c.select(score, tp.alias("tp"), fp.alias("fp"), F.when(F.col("t_p") > 0, tp / F.col("t_p")).alias("tpr"), F.when(F.col("t_n") > 0, fp / F.col("t_n")).alias("fpr"), (tp / (tp + fp)).alias("precision"), F.col("p"), F.col("n"), F.col("t_p"), F.col("t_n"))


def auc(points: DataFrame) -> DataFrame:
    """(auc): trapezoids under a curve; each point knows the step from the one before, so no order is needed. Null where all rows are true
    or none is."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return points.agg(F.try_divide(area, F.max("t_p").cast("double") * F.max("t_n")).alias("auc"))


def moving_mean(x: Column, half: int) -> Column:
    """Mean over up to half neighbours on either side, shorter at the ends."""
    part = lambda i: F.slice(x, F.greatest(i + 1 - half, F.lit(1)), F.least(i + half, F.size(x) - 1) - F.greatest(i - half, F.lit(0)) + 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: total(part(i)))


def positive_mean_norm(x: Column) -> Column:
    """Divided by the mean of the positive entries; unchanged without any."""
    pos = F.filter(x, lambda v: v > 0)
    mean = F.aggregate(pos, F.lit(0.0), lambda s, v: s + v) / F.size(pos)
    return F.when(F.size(pos) > 0, F.transform(x, lambda v: v / mean)).otherwise(x)


def squash(x: Column, mean: Column, sd: Column) -> Column:
    """Logistic of the standardised entries; zeros stay."""
    return F.transform(x, lambda v: F.when(v == 0, 0.0).otherwise(1 / (1 + F.exp(-(v - mean) / sd))))


def slope_weights(size: int, order: int, deriv: int = 1) -> list[float]:
    """Least-squares polynomial filter: row deriv of the pseudo-inverse over a centred window of odd size."""
    half = size // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[deriv].tolist()


def convolve(x: Column, weights: list[float]) -> Column:
    """Weighted sums over every full window."""
    w, n = F.array(*map(F.lit, weights)), len(weights)
    at = lambda i: F.aggregate(F.zip_with(F.slice(x, i, n), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), at)).otherwise(F.array().cast("array<double>"))


def protection(x: Column, centre: int) -> tuple[Column, Column]:
    """Mean of the flanks less mean of the centre columns, and the sum of all: protection score and tag count."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    side = F.floor((F.size(x) - centre) / 2).cast("int")
    mid, total = add(F.slice(x, side + 1, centre)), add(x)
    return (total - mid) / (F.size(x) - centre) - mid / centre, total


def size_factors(df: DataFrame, key: str, condition: str, value: str) -> DataFrame:
    """(condition, factor): exp of the median over keys of the log value less the key's mean log over conditions."""
    logs = df.filter(F.col(value) > 0).withColumn("_l", F.log(value))
    mean = logs.groupBy(key).agg(F.avg("_l").alias("_m"))
    return logs.join(mean, key).groupBy(condition).agg(F.exp(F.percentile(F.col("_l") - F.col("_m"), 0.5)).alias("factor"))


def strand_shift(reads: DataFrame, shifts: range) -> DataFrame:
    """(shift, n): distinct forward starts that meet a distinct reverse end at that shift; the best n tells the fragment size."""
    fwd = reads.filter("orientation = '+'").select("chrom", F.col("initial").alias("at")).distinct()
    rev = reads.filter("orientation = '-'").select("chrom", F.col("final").alias("end")).distinct()
    moved = rev.select("chrom", F.explode(F.array(*(F.lit(k).cast("bigint") for k in shifts))).alias("shift"), "end").withColumn("at", F.col("end") - F.col("shift"))
    return moved.join(fwd, ["chrom", "at"]).groupBy("shift").agg(F.count(F.lit(1)).alias("n"))


def merge_bins(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, initial, final, n, value): bins of equal keys whose ends meet are joined, their values added."""
    from .islands import with_islands

    return with_islands(df, 1, keys).groupBy(*keys, "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n"), F.sum(value).alias(value)).drop("_island")


def mean_signal(regions: DataFrame, signal: DataFrame) -> DataFrame:
    """(_ord, mean): signal (place, value) averaged over a region's covered positions; 0 where there is no signal."""
    from .joins import overlap_join

    hit = overlap_join(regions.select("_ord", "chrom", "initial", "final"), signal.select("chrom", "initial", "final", "value"))
    width = F.least("final", "b_final") - F.greatest("initial", "b_initial")
    mean = hit.groupBy("_ord").agg((F.sum(F.col("b_value") * width) / F.sum(width)).alias("mean"))
    return regions.select("_ord").join(mean, "_ord", "left").fillna(0.0, ["mean"])


def putative_bins(df: DataFrame, keys: tuple[str, ...], sample: str, value: str, least: float) -> DataFrame:
    """(keys, score): bins whose values, each over its sample's mean of its own bins, add up to more than least."""
    mean = df.groupBy(sample).agg(F.avg(value).alias("_m"))  # a row for each sample
    return df.join(mean, sample).groupBy(*keys).agg(F.sum(F.col(value) / F.col("_m")).alias("score")).filter(F.col("score") > least)


def extraction_factor(df: DataFrame, signal: str, control: str) -> DataFrame:
    """(cut, factor): the scale of a control by signal extraction. Bins are put in order of the signal; where the running share of
    the control lies furthest above that of the signal, bins are background, and the factor is their signal over their control. Bins of equal signal
    are taken together, so what is put in order is a row for each count that occurs."""
    per = df.groupBy(F.col(signal).alias("cut")).agg(F.sum(signal).alias("_x"), F.sum(control).alias("_y"))
    upto = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = per.agg(F.sum("_x").alias("_tx"), F.sum("_y").alias("_ty"))
    rows = per.select("cut", F.sum("_x").over(upto).alias("_x"), F.sum("_y").over(upto).alias("_y")).crossJoin(total)  # one row
    gap = F.col("_y") / F.nullif(F.col("_ty"), F.lit(0)) - F.col("_x") / F.nullif(F.col("_tx"), F.lit(0))
    best = rows.agg(F.max_by(F.struct("cut", "_x", "_y"), F.struct(gap, -F.col("cut"))).alias("m"))
    return best.select("m.cut", (F.col("m._x") / F.nullif(F.col("m._y"), F.lit(0))).alias("factor"))


def gene_factors(df: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, factor): df has a row for each gene with a column of counts for each sample. One is added to every count; a sample's factor
    is the mean over genes of the gene's mean count over its count in the sample."""
    counts = [F.coalesce(F.col(c), F.lit(0)) + 1 for c in samples]
    mean = sum(counts[1:], counts[0]) / len(samples)
    factors = df.agg(*(F.avg(mean / n).alias(c) for c, n in zip(samples, counts, strict=True)))
    return factors.unpivot([], samples, "sample", "factor")
