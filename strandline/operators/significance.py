"""Exact tests on counted tables: a row holds the counts, so the Python part sees a few numbers a row; and placement tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .islands import merge
from .joins import intersect, overlap_join
from .placement import hashed


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_tail(a: int, b: int, c: int, d: int) -> float:
    """P(at least a) of the table ((a, b), (c, d)) under fixed margins. Terms fall from the mode on, so the sum ends early."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)
    mode = (row + 1) * (col + 1) // (n + 2)

    def side(k: int, step: int) -> float:
        total = term = math.exp(_log_choose(col, k) + _log_choose(n - col, row - k) - _log_choose(n, row))
        while low <= k + step <= high and term > total * 1e-17:
            term *= (col - k) * (row - k) / ((k + 1) * (n - col - row + k + 1)) if step > 0 else k * (n - col - row + k) / ((col - k + 1) * (row - k + 1))
            total, k = total + term, k + step
        return total

    if a <= low:
        return 1.0
    return min(1.0, side(a, 1) if a > mode else 1 - side(a - 1, -1))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    d = 1 / (1 - (a + b) * x / (a + 1))
    h, c, m = d, 1.0, 1
    while m < 100_000:
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
        m += 1
    return front * h


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Probability of all outcomes no likelier than k; the far tail's edge is found by bisection, so n may be large."""
    if n == 0 or p <= 0 or p >= 1:
        return 1.0 if n == 0 or k == (0 if p <= 0 else n) else 0.0
    log = lambda j: _log_choose(n, j) + j * math.log(p) + (n - j) * math.log1p(-p)
    below = lambda j: 1.0 if j >= n else 0.0 if j < 0 else 1 - _beta(j + 1, n - j, p)  # P(X <= j)
    mode, edge = min(n, int((n + 1) * p)), log(k) + 1e-9
    if k == mode:
        return 1.0
    lo, hi = (mode, n + 1) if k < mode else (-1, mode)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (log(mid) <= edge) == (k < mode):
            hi = mid
        else:
            lo = mid
    above = lambda j: 0.0 if j > n else 1.0 if j <= 0 else _beta(j, n - j + 1, p)  # P(X >= j)
    return min(1.0, below(k) + above(hi) if k < mode else above(k) + below(lo))


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_tail(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(x), int(y), float(z)) for x, y, z in zip(k, n, p, strict=True)], dtype=float)


def projection_test(reference: DataFrame, query: DataFrame, genome: int) -> DataFrame:
    """(k, n, p, p_value): query midpoints inside the reference, all midpoints, covered share of the genome, two-sided binomial.
    A midpoint exactly on a region's start is no hit."""
    mid = F.floor((F.col("initial") + F.col("final")) / 2)
    points = query.select("_ord", "chrom", mid.alias("initial"), (mid + 1).alias("final"))
    ref = merge(reference)
    hits = overlap_join(points, ref.select("chrom", (F.col("initial") + 1).alias("initial"), "final").filter("initial < final")).select("_ord").distinct().agg(F.count(F.lit(1)).alias("k"))
    counts = hits.join(query.agg(F.count(F.lit(1)).alias("n"))).join(ref.agg((F.coalesce(F.sum(F.col("final") - F.col("initial")), F.lit(0)) / genome).alias("p")))  # three one-row sums
    return counts.withColumn("p_value", binomial("k", "n", "p"))


def placed(df: DataFrame, repeats: int, length: int, seed: int = 1) -> DataFrame:
    """df in repeats random placements: each row keeps its size and chromosome and moves to a hashed start; chrom becomes
    rep:chrom, so that replicates never meet in joins."""
    size = F.col("final") - F.col("initial")
    rep = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    start = hashed(F.col("rep").cast("string"), F.col("_ord").cast("string"), F.lit(str(seed))) % F.greatest(F.lit(length) - size, F.lit(1))
    return rep.withColumn("_s", size).withColumns({"chrom": F.concat_ws(":", "rep", "chrom"), "initial": start, "final": start + F.col("_s")}).drop("_s")


def jaccard_test(a: DataFrame, b: DataFrame, repeats: int, length: int) -> DataFrame:
    """(observed, repeats, n_larger, p_value): how many random placements of a have a larger Jaccard index with b."""
    merged = merge(b).select("chrom", "initial", "final")
    each = merged.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("chrom", F.concat_ws(":", "rep", "chrom")).drop("rep")
    b_bp = merged.agg(F.coalesce(F.sum(F.col("final") - F.col("initial")), F.lit(0)).alias("b_bp"))

    def index(x: DataFrame, y: DataFrame, rep) -> DataFrame:
        bp = lambda d, name: d.groupBy(rep.alias("rep")).agg(F.sum(F.col("final") - F.col("initial")).alias(name))
        both = bp(merge(x), "a_bp").join(bp(intersect(x, y), "both"), "rep", "left").fillna(0, ["both"])
        return both.join(F.broadcast(b_bp)).select("rep", (F.col("both") / (F.col("a_bp") + F.col("b_bp") - F.col("both"))).alias("j"))

    seen = index(a, merged, F.lit("0")).select(F.col("j").alias("observed"))
    random = index(placed(a, repeats, length), each, F.substring_index("chrom", ":", 1))
    return random.join(F.broadcast(seen)).groupBy("observed").agg(F.count(F.lit(1)).alias("repeats"), F.count_if(F.col("j") > F.col("observed")).alias("n_larger")).withColumn("p_value", F.col("n_larger") / F.lit(repeats))
