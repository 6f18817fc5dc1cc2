"""Nucleotide expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def gc_content(seq: Column) -> Column:
    """Share of G and C; null for the empty sequence."""
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / F.length(seq))


def kmer_counts(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n) over all sequences. Each of the k phases is cut in one pass, so cost is linear in length; counts are combined in
    each task before the shuffle."""
    phases = [F.regexp_extract_all(F.substring(seq, i + 1, 1 << 30), F.lit(f"(?s)(.{{{k}}})"), F.lit(1)) for i in range(k)]
    return df.select(F.explode(F.flatten(F.array(*phases))).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
