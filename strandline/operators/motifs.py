"""Motif sites inside regions of a genome in pieces, and enrichment of motifs in regions against a background."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import motif
from ..lineage import written
from .binned import label_hits
from .joins import overlap_join
from .significance import fisher
from .stats import corrected

PLACE = ("chrom", "initial", "final")


def sites_in_regions(regions: DataFrame, chunks: DataFrame, size: int, motifs: dict[str, np.ndarray], threshold: float | dict[str, float], best: bool = True) -> DataFrame:
    """(_ord, chrom, initial, final, motif, strand, score): sites wholly inside each region, of both strands or, with best, the better one.

    Pieces (chrom, chunk, seq) that regions touch are scanned once each, whatever regions share them, with as many letters of the next
    piece as a motif is long less one; a site belongs to the piece that it begins in. So no region and no chromosome is ever one string."""
    width = max(w.shape[1] for w in motifs.values())
    if width > size:
        raise ValueError("pieces are shorter than a motif")
    places = regions.filter("initial < final").select("_ord", *PLACE)
    touched = places.select("chrom", F.explode(F.sequence(F.floor(F.col("initial") / size), F.floor((F.col("final") - 1) / size))).alias("chunk")).distinct()
    after = chunks.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", 1, width - 1).alias("_next"))
    rows = chunks.join(touched, ["chrom", "chunk"], "left_semi").join(after, ["chrom", "chunk"], "left")
    rows = written(rows.select("chrom", "chunk", F.concat("seq", F.coalesce("_next", F.lit(""))).alias("seq")).withColumn("_id", F.monotonically_increasing_id()))
    hits = motif.scan(rows, "_id", motifs, threshold).filter(F.col("start") < size)
    hits = motif.best_strand(hits, "_id") if best else hits
    long = F.element_at(F.create_map(*(F.lit(x) for name, w in motifs.items() for x in (name, w.shape[1]))), F.col("motif"))
    at = F.col("chunk") * size + F.col("start")
    found = hits.join(rows.select("_id", "chrom", "chunk"), "_id").select("chrom", at.alias("initial"), (at + long).alias("final"), "motif", "strand", "score")
    inside = (F.col("initial") <= F.col("b_initial")) & (F.col("final") >= F.col("b_final"))
    met = overlap_join(places, found, on=inside)
    return met.select("_ord", "chrom", F.col("b_initial").alias("initial"), F.col("b_final").alias("final"), *(F.col(f"b_{c}").alias(c) for c in ("motif", "strand", "score")))


def enrichment(regions: DataFrame, sites: DataFrame, background: DataFrame, background_sites: DataFrame, label: str = "motif") -> DataFrame:
    """(motif, a, b, c, d, p, q, frequency, background_frequency, genes): for every motif with a site in either set, regions (unique _ord, name)
    with a site and without, background rows with one and without, the right tail of Fisher's exact test, corrected over the motifs, the
    shares, and the distinct names of regions with a site. A set without rows has a null share."""
    own = label_hits(regions, sites, label, names=True).select(F.col("label").alias("motif"), F.col("regions_hit").alias("a"), "genes")
    other = label_hits(background, background_sites, label).select(F.col("label").alias("motif"), F.col("regions_hit").alias("c"))
    total = regions.agg(F.count(F.lit(1)).alias("n")).crossJoin(background.agg(F.count(F.lit(1)).alias("m")))  # two one-row counts
    rows = own.join(other, "motif", "full").fillna(0, ["a", "c", "genes"]).crossJoin(total)  # one row
    table = rows.select("motif", "a", (F.col("n") - F.col("a")).alias("b"), "c", (F.col("m") - F.col("c")).alias("d"), "genes", F.try_divide("a", "n").alias("frequency"), F.try_divide("c", "m").alias("background_frequency"))
    return corrected(table.withColumn("p", fisher("a", "b", "c", "d")), "p").select("motif", "a", "b", "c", "d", "p", "q", "frequency", "background_frequency", "genes")
