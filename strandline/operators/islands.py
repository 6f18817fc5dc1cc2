"""Merging and clustering of intervals by a running maximum that is scanned in blocks.

A chromosome isn't one task: rows are windowed inside (chrom, block of coordinates), and what crosses blocks is one row for each
block, the greatest end so far and the number of islands so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def with_islands(df: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """df with _island, numbered by keys in order of start. Rows join an island if they begin before its end plus gap; touching
    rows stay apart at gap 0."""
    rows = df.withColumn("_block", F.floor(F.col("initial") / block))
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*keys, "_block").orderBy("initial", "final")
    carry = rows.groupBy(*keys, "_block").agg(F.max("final").alias("_top")).withColumn("_carry", F.max("_top").over(by_block)).drop("_top")
    before = F.greatest("_carry", F.max("final").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(carry, [*keys, "_block"]).withColumn("_new", F.when(before.isNull() | (F.col("initial") - gap >= before), 1).otherwise(0))
    start = marked.groupBy(*keys, "_block").agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(by_block), F.lit(0))).drop("_n")
    local = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # a range: rows at one place may be sorted anew, and share an island
    return marked.join(start, [*keys, "_block"]).withColumn("_island", local + F.col("_base")).drop("_block", "_carry", "_new", "_base")


def merge(df: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """(keys, initial, final, n): union of overlapping rows (gap 0) or of rows up to gap apart.

    Rows are shuffled once, by key and block, and merged there; what goes on are islands of blocks. Those that reach over from
    earlier blocks are joined to them by a running maximum over blocks."""
    rows = df.select(*keys, "initial", "final").withColumn("_block", F.floor(F.col("initial") / block))
    order = Window.partitionBy(*keys, "_block").orderBy("initial", "final")
    before = F.max("final").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col("initial") - gap >= before), 1).otherwise(0))
    marked = marked.withColumn("_local", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    local = marked.groupBy(*keys, "_block", "_local").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*keys, "_block").orderBy("_local")
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = local.groupBy(*keys, "_block").agg(F.max("final").alias("_top"))
    carry = tops.select(*keys, "_block", F.max("_top").over(by_block).alias("_carry"))  # a row for each block
    # An island of a block is a new one unless it begins before what earlier blocks reach; a stretch of such islands is one with the last of theirs.
    starts = local.join(carry, [*keys, "_block"]).withColumn("_new", F.when(F.col("_carry").isNull() | (F.col("initial") - gap >= F.col("_carry")), 1).otherwise(0))
    base = starts.groupBy(*keys, "_block").agg(F.sum("_new").alias("_n")).select(*keys, "_block", F.coalesce(F.sum("_n").over(by_block), F.lit(0)).alias("_base"))
    numbered = starts.join(base, [*keys, "_block"]).withColumn("_island", F.col("_base") + F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.sum("n").alias("n")).drop("_island")
