"""Queries of motif sites in regions and their enrichment, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motifs as M
from ..operators import tools
from . import views as V
from .catalog import COLS, OV, query
from .signal_queries import COUNTS, CUT, SCAN, fisher_sql, matrices
from .tool_queries import SIZE, dna_regions


@query(f"""SELECT r._ord, r.chrom, start AS initial, start + width AS final, motif, strand, round(score, 6) AS score FROM (
  SELECT doc_id, motif, start, max(score) AS score, CASE WHEN count(*) = 1 THEN any_value(strand) ELSE arg_max(strand, (score, CASE WHEN strand = '+' THEN 1 ELSE 0 END)) END AS strand FROM ({SCAN}) GROUP BY doc_id, motif, start) h
JOIN (SELECT doc_id AS _ord, doc_id::VARCHAR AS chrom, doc_id % 150 AS initial, doc_id % 150 + 20 + doc_id % 70 AS final FROM dna) r ON r._ord = h.doc_id
JOIN (SELECT unnest({list(COUNTS)!r}) AS motif, unnest({[len(c[0]) for c in COUNTS.values()]!r}) AS width) USING (motif) WHERE start >= r.initial AND start + width <= r.final""")
def sites_in_regions(s, d):
    genome = V.dna(s, d).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    return M.sites_in_regions(dna_regions(s, d), tools.chunked(genome, SIZE), SIZE, matrices(), CUT).withColumn("score", F.round("score", 6))


SIDE = "SELECT b.name AS motif, count(DISTINCT a._ord) AS hit, count(DISTINCT a.name) AS genes FROM {rel} a JOIN reg_a b ON " + OV + " GROUP BY b.name"


@query(f""", t AS (SELECT motif, coalesce(x.hit, 0) AS a, (SELECT count(*) FROM genes) - coalesce(x.hit, 0) AS b, coalesce(y.hit, 0) AS c, (SELECT count(*) FROM reg_b) - coalesce(y.hit, 0) AS d, coalesce(x.genes, 0) AS genes
  FROM ({SIDE.format(rel='genes')}) x FULL JOIN ({SIDE.format(rel='reg_b')}) y USING (motif)),
p AS (SELECT *, {fisher_sql('a', 'b', 'c', 'd')} AS p FROM t), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY round(p, 9)) AS raw FROM p)
SELECT motif, a, b, c, d, genes, round(a / (a + b), 6) AS frequency, round(c / (c + d), 6) AS background_frequency, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY round(p, 9) DESC)), 6) AS q FROM r""")
def site_enrichment(s, d):
    """Names of one set as motifs, in genes against orders."""
    sites = V.reg_a(s, d).select(*COLS, F.col("name").alias("motif"))
    out = M.enrichment(V.genes(s, d), sites, V.reg_b(s, d), sites)
    return out.select("motif", "a", "b", "c", "d", "genes", *(F.round(c, 6).alias(c) for c in ("frequency", "background_frequency", "p", "q")))
