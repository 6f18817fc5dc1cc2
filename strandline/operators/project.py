"""Row-wise interval operators: native column expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extend(df: DataFrame, left: int, right: int) -> DataFrame:
    """Ends moved outwards; negative values shrink, inverted ends swap, starts stay at 0 or above."""
    i, f = F.col("initial") - left, F.col("final") + right
    return df.withColumns({"initial": F.greatest(F.least(i, f), F.lit(0)), "final": F.greatest(i, f)})


def extend_stream(df: DataFrame, length: int, up: bool = True) -> DataFrame:
    """Extended against (up) or along the strand; anything but + counts as -."""
    at_start = (F.col("orientation") == "+") if up else F.coalesce(F.col("orientation") != "+", F.lit(True))
    at_start = F.coalesce(at_start, F.lit(False))
    return df.withColumns({"initial": F.when(at_start, F.greatest(F.col("initial") - length, F.lit(0))).otherwise(F.col("initial")), "final": F.when(at_start, F.col("final")).otherwise(F.col("final") + length)})


def flank(df: DataFrame, size: int) -> DataFrame:
    """Two rows for each: before and after it."""
    i, f = F.col("initial"), F.col("final")
    sides = F.array(F.struct(F.greatest(i - size, F.lit(0)).alias("i"), i.alias("f"), F.lit("upstream").alias("side")), F.struct(f.alias("i"), (f + size).alias("f"), F.lit("downstream").alias("side")))
    return df.withColumn("_s", F.explode(sides)).withColumns({"initial": F.col("_s.i"), "final": F.col("_s.f"), "side": F.col("_s.side")}).drop("_s")


def extend_percent(df: DataFrame, left: float, right: float) -> DataFrame:
    """Ends moved outwards by a share of the length, cut to whole positions; starts stay at 0 or above."""
    n = F.col("final") - F.col("initial")
    part = lambda x: (n * x / 100).cast("bigint")
    i, f = F.col("initial") - part(left), F.col("final") + part(right)
    return df.withColumns({"initial": F.greatest(F.least(i, f), F.lit(0)), "final": F.greatest(i, f)})


def relocate(df: DataFrame, center: str = "midpoint", left: int = 2000, right: int = 2000) -> DataFrame:
    """Re-centred on midpoint, leftend, rightend, upstream or downstream (along the strand; anything but + counts as -) or bothends
    (two rows), and extended."""
    i, f = F.col("initial"), F.col("final")
    plus = F.coalesce(F.col("orientation") == "+", F.lit(False)) if "orientation" in df.columns else F.lit(False)
    at = {
        "midpoint": F.floor((i + f) / 2), "leftend": i, "rightend": f, "upstream": F.when(plus, i).otherwise(f),
        "downstream": F.when(plus, f).otherwise(i), "bothends": F.explode(F.array(i, f)),
    }[center]
    return df.select("*", at.alias("_at")).withColumn("_at", F.col("_at").cast("bigint")).withColumns({"initial": F.greatest(F.col("_at") - left, F.lit(0)), "final": F.col("_at") + right}).drop("_at")


def fragmentize(df: DataFrame, size: int) -> DataFrame:
    """Pieces of a fixed size, the remainder dropped; shorter rows stay as they are."""
    n = F.floor((F.col("final") - F.col("initial")) / size)
    k = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    return df.withColumn("_k", k).withColumns({"final": F.when(F.col("final") - F.col("initial") < size, F.col("final")).otherwise(F.col("initial") + (F.col("_k") + 1) * size), "initial": F.col("initial") + F.col("_k") * size}).drop("_k")


def promoters(df: DataFrame, length: int = 1000) -> DataFrame:
    """The window before each row's start along its strand; anything but + uses the right side."""
    plus = F.coalesce(F.col("orientation") == "+", F.lit(False))
    return df.withColumns({"initial": F.when(plus, F.greatest(F.col("initial") - length, F.lit(0))).otherwise(F.col("final")), "final": F.when(plus, F.col("initial")).otherwise(F.col("final") + length)})


def flip_strand(df: DataFrame) -> DataFrame:
    return df.withColumn("orientation", F.translate("orientation", "+-", "-+"))


def label(df: DataFrame):
    """Name, or chrom:initial-final where there is none."""
    return F.coalesce(F.col("name"), F.format_string("%s:%d-%d", "chrom", "initial", "final"))


def stream_window(df: DataFrame, distance: int, length: int, up: bool = True) -> DataFrame:
    """The window of a length at a distance before (up) or after each row along its strand; starts stay at 0 or above, and windows
    that would lie before the chromosome are left out."""
    left = F.coalesce(F.col("orientation") == "+", F.lit(False)) == F.lit(up)
    end = F.when(left, F.col("initial") - distance).otherwise(F.col("final") + distance + length)
    return df.withColumn("_e", end).filter("_e > 0").withColumns({"initial": F.greatest(F.col("_e") - length, F.lit(0)), "final": F.col("_e")}).drop("_e")
