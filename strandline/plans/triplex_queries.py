"""Queries of triplex hits, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triplex as T
from . import views as V
from .catalog import COLS, OV, isl, query
from .signal_queries import fisher_sql

REGIONS = "(SELECT * FROM genes WHERE score > 25)"
TPX = """tpx AS (SELECT _ord, chrom, initial, final, orientation, rna_i, rna_i + 10 + score % 7 AS rna_f, substr('MRY', (score % 3 + 1)::INT, 1) AS motif, substr('AGGATCcUA-', 1, (4 + score % 7)::INT) AS match
  FROM (SELECT *, (_ord % 100003 * 7919) % 100003 % 9000 // 20 * 20 AS rna_i FROM reads))"""


def hits(s, d):
    """Reads as DNA places, with a place on an RNA of 9,000 bases, a motif and an alignment."""
    at = F.floor((F.col("_ord") % 100003 * 7919) % 100003 % 9000 / 20) * 20
    rows = V.reads(s, d).select("_ord", *COLS, "orientation", at.alias("rna_i"), "score")
    score = F.col("score")
    return rows.select("_ord", *COLS, "orientation", "rna_i", (F.col("rna_i") + 10 + score % 7).alias("rna_f"), F.substr(F.lit("MRY"), (score % 3 + 1).cast("int"), F.lit(1)).alias("motif"), F.substr(F.lit("AGGATCcUA-"), F.lit(1), (4 + score % 7).cast("int")).alias("match"))


WALK = """walk AS (SELECT *, CASE WHEN (rna_f + _ord) % 2 = 0 THEN 'P' ELSE 'A' END AS direction FROM (SELECT * REPLACE (rna_i % 600 AS rna_i, rna_f - rna_i + rna_i % 600 AS rna_f) FROM tpx)
  QUALIFY row_number() OVER (ORDER BY rna_i DESC, rna_f DESC, _ord DESC) > 2),
pairs AS (SELECT a.*, b.orientation AS bo, b.motif AS bm, b.direction AS bd, b.initial AS bi, b.final AS bf, b.rna_i - a.rna_f AS gap, greatest(b.initial - a.final, a.initial - b.final, 0) AS dgap FROM walk a JOIN walk b ON a.chrom = b.chrom
  AND b.rna_i > a.rna_f AND b.rna_i - a.rna_f < 20 AND b.initial - a.final <= 20 AND a.initial - b.final <= 20 AND (a.motif <> b.motif OR a.direction <> b.direction)),
kinds AS (SELECT CASE WHEN orientation = bo AND direction = bd THEN CASE
    WHEN direction = 'P' AND ((orientation = '+' AND final < bi) OR (orientation = '-' AND bf < initial)) THEN CASE WHEN motif = 'Y' THEN 'C_YM' ELSE 'C_MY' END
    WHEN direction = 'A' AND ((orientation = '+' AND bf < initial) OR (orientation = '-' AND final < bi)) THEN CASE WHEN motif = 'M' THEN 'C_MR' ELSE 'C_RM' END END
  WHEN orientation = bo THEN CASE WHEN gap > dgap + bf - bi THEN 'SR_' || motif || bm END
  WHEN direction <> bd THEN CASE WHEN direction = 'P' AND orientation = '+' AND final < bi THEN 'SD_PA_pos' WHEN direction = 'P' AND orientation = '-' AND bf < initial THEN 'SD_PA_neg'
    WHEN direction = 'A' AND orientation = '+' AND bf < initial THEN 'SD_AP_pos' WHEN direction = 'A' AND orientation = '-' AND final < bi THEN 'SD_AP_neg' END END AS kind FROM pairs)"""


@query(f", {TPX}, {WALK} SELECT k.kind, count(kinds.kind) AS n FROM (SELECT unnest({list(T.SWITCHES)!r}) AS kind) k LEFT JOIN kinds USING (kind) GROUP BY k.kind")
def triplex_switch_kinds(s, d):
    """Hits on an RNA of 600 bases, so that many lie near each other, with a direction."""
    site = F.col("rna_i") % 600
    rows = hits(s, d).withColumn("rna_f", F.col("rna_f") - F.col("rna_i") + site).withColumn("rna_i", site)
    return T.switch_kinds(rows.withColumn("direction", F.when((F.col("rna_f") + F.col("_ord")) % 2 == 0, "P").otherwise("A")))


@query(f", {TPX} SELECT _ord, rna_i AS initial, rna_f AS final, rna_i || '-' || rna_f || CASE WHEN orientation = '-' THEN '--' ELSE '' END AS label FROM tpx WHERE orientation = '-'")
def triplex_rna_sites(s, d):
    return T.rna_sites(hits(s, d), "-")


@query(f", {TPX} SELECT DISTINCT chrom, initial, final, orientation FROM tpx WHERE orientation = '+'")
def triplex_dna_sites(s, d):
    return T.dna_sites(hits(s, d), "+", distinct=True)


@query(f", {TPX} SELECT motif, orientation, base, count(*) AS n FROM (SELECT motif, orientation, unnest(string_split(match, '')) AS base FROM tpx) WHERE regexp_full_match(base, '[ACGTU]') GROUP BY ALL")
def triplex_base_statistics(s, d):
    return T.base_statistics(hits(s, d))


@query(f", {TPX} SELECT position, motif, orientation, count(*) AS n FROM (SELECT motif, orientation, unnest(range(rna_i, rna_f)) AS position FROM tpx) GROUP BY ALL")
def triplex_position_motifs(s, d):
    return T.position_motifs(hits(s, d))


@query(f""", {TPX} SELECT motif AS first, m2 AS second, orientation = o2 AS same_strand, count(*) AS n FROM (SELECT *, lead(motif) OVER w AS m2, lead(orientation) OVER w AS o2, lead(initial) OVER w AS i2 FROM tpx
WINDOW w AS (PARTITION BY chrom ORDER BY initial, final, _ord)) WHERE i2 - final < 20 GROUP BY ALL""")
def triplex_switches(s, d):
    return T.switches(hits(s, d))


@query(f""", {TPX}, met AS (SELECT a._ord, b.rna_i, b.rna_f, greatest(a.initial, b.initial) AS x, least(a.final, b.final) AS y FROM genes a JOIN tpx b ON {OV}),
m AS (SELECT _ord AS chrom, x AS initial, y AS final, row_number() OVER () AS _ord FROM met)
SELECT g._ord, coalesce(n_hits, 0) AS n_hits, coalesce(n_sites, 0) AS n_sites, coalesce(covered, 0)::BIGINT AS covered FROM genes g LEFT JOIN (SELECT _ord, count(*) AS n_hits, count(DISTINCT (rna_i, rna_f)) AS n_sites FROM met GROUP BY _ord) USING (_ord)
LEFT JOIN (SELECT chrom AS _ord, sum(final - initial) AS covered FROM {isl('m')} GROUP BY chrom) USING (_ord)""")
def triplex_by_region(s, d):
    return T.by_region(hits(s, d), V.genes(s, d))


R = "r AS (SELECT 'rna' AS chrom, rna_i AS initial, rna_f AS final, _ord FROM tpx)"
DOMAINS = f"""{TPX}, {R}, dom AS (SELECT initial AS d_i, final AS d_f FROM {isl('r')}), inside AS (SELECT d_i, d_f, tpx.* FROM tpx JOIN dom ON rna_i >= d_i AND rna_f <= d_f)"""


def _bound(rel: str) -> str:
    return f"(SELECT d_i, d_f, count(DISTINCT b._ord) AS n FROM inside a JOIN {rel} b ON {OV} GROUP BY ALL)"


@query(f", {DOMAINS} SELECT d_i, d_f, n AS bound FROM {_bound('genes')}")
def triplex_domain_counts(s, d):
    return T.domain_counts(hits(s, d), V.genes(s, d))


@query(f""", {DOMAINS}, t AS (SELECT d_i, d_f, coalesce(x.n, 0) AS a, (SELECT count(*) FROM {REGIONS}) - coalesce(x.n, 0) AS b, coalesce(y.n, 0) AS c, (SELECT count(*) FROM genes WHERE score <= 25) - coalesce(y.n, 0) AS d
FROM dom LEFT JOIN {_bound(REGIONS)} x USING (d_i, d_f) LEFT JOIN {_bound('(SELECT * FROM genes WHERE score <= 25)')} y USING (d_i, d_f)) SELECT d_i, d_f, a, b, c, d, round({fisher_sql('a', 'b', 'c', 'd')}, 5) AS p FROM t""")
def triplex_domain_tests(s, d):
    g = V.genes(s, d)
    return T.domain_tests(hits(s, d), g.filter("score > 25"), g.filter("score <= 25")).withColumn("p", F.round("p", 5))


@query(f""", {DOMAINS}, places AS (SELECT rep, _ord, chrom, final - initial AS size, ('0x' || substr(md5(rep || ':' || _ord || ':1'), 1, 12))::BIGINT % greatest(1000000 - (final - initial), 1) AS initial FROM genes, range(1, 21) t(rep)),
moved AS (SELECT rep, _ord, chrom, initial, initial + size AS final FROM places), per AS (SELECT d_i, d_f, rep, count(DISTINCT b._ord) AS n FROM inside a JOIN moved b ON {OV} GROUP BY ALL)
SELECT d_i, d_f, coalesce(o.n, 0) AS bound, round(coalesce(s, 0) / 20, 5) AS mean, round(sqrt(greatest(coalesce(ss, 0) / 20 - (coalesce(s, 0) / 20) * (coalesce(s, 0) / 20), 0)), 5) AS sd, CASE WHEN o.n IS NULL THEN 1.0 ELSE (SELECT count(*) FROM per WHERE per.d_i = dom.d_i AND per.d_f = dom.d_f AND per.n >= o.n) / 20 END AS p
FROM dom LEFT JOIN {_bound('genes')} o USING (d_i, d_f) LEFT JOIN (SELECT d_i, d_f, sum(n) AS s, sum(n * n) AS ss FROM per GROUP BY ALL) USING (d_i, d_f)""")
def triplex_permutations(s, d):
    return T.permutation_tests(hits(s, d), V.genes(s, d), 20, 1000000).withColumns({"mean": F.round("mean", 5), "sd": F.round("sd", 5)})
