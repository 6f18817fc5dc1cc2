"""Coverage over a stream of intervals: counts by chromosome, bin and event-time window, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bins(stream: DataFrame, bin_size: int, window: str, late: str, time: str = "ts") -> DataFrame:
    """(chrom, bin, start, n) of intervals (chrom, initial, time); rows later than late are dropped, state is bounded by it."""
    bins = F.floor(F.col("initial") / bin_size).alias("bin")
    per = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "chrom", bins).agg(F.count(F.lit(1)).alias("n"))
    return per.select("chrom", "bin", F.col("w.start").alias("start"), "n")
