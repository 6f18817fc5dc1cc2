"""Queries of the everyday compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tools
from . import views as V
from .catalog import COLS, OV, isl, query

SIZE = 64


def dna_regions(s, d):
    """Regions of up to 90 letters on each document's letters, every third on the minus strand."""
    return V.dna(s, d).select(F.col("doc_id").alias("_ord"), F.col("doc_id").cast("string").alias("chrom"), (F.col("doc_id") % 150).alias("initial"), (F.col("doc_id") % 150 + 20 + F.col("doc_id") % 70).alias("final"), F.when(F.col("doc_id") % 3 == 0, "-").otherwise("+").alias("orientation"))


@query("""SELECT doc_id AS _ord, CASE WHEN doc_id % 3 = 0 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq FROM (SELECT doc_id,
  substr(seq, (greatest(doc_id % 150 - 5, 0) + 1)::INT, (doc_id % 150 + 25 + doc_id % 70 - greatest(doc_id % 150 - 5, 0))::INT) AS s FROM dna) WHERE s <> ''""")
def region_sequences(s, d):
    genome = V.dna(s, d).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    return tools.sequences(dna_regions(s, d), tools.chunked(genome, SIZE), SIZE, ex=5)


HIT = "SELECT DISTINCT a._ord, '{n}' AS reference FROM reg_a a JOIN {n} b ON " + OV


@query(f", h AS ({HIT.format(n='reg_b')} UNION ALL {HIT.format(n='genes')}) SELECT reference, count(*) AS n FROM (FROM h UNION ALL SELECT _ord, 'else' FROM reg_a WHERE _ord NOT IN (SELECT _ord FROM h)) GROUP BY reference")
def overlap_profile(s, d):
    return tools.overlap_profile(V.reg_a(s, d), {"reg_b": V.reg_b(s, d), "genes": V.genes(s, d)})


@query(f"""SELECT b.name AS motif, count(DISTINCT a._ord) AS regions_hit, (SELECT count(*) FROM genes) - count(DISTINCT a._ord) AS regions_not, count(DISTINCT a.name) AS genes, count(DISTINCT (b.chrom, b.initial, b.final)) AS sites
FROM genes a JOIN reg_a b ON {OV} GROUP BY b.name""")
def contingency_tables(s, d):
    return tools.contingency(V.genes(s, d), V.reg_a(s, d), "name")


@query("""SELECT name, gene_id FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT lower(c_name) FROM customer) n LEFT JOIN (
  SELECT DISTINCT upper(c_name) AS a, c_custkey AS gene_id FROM customer UNION SELECT upper(s_name), s_suppkey FROM supplier) x ON upper(name) = a""")
def alias_lookup(s, d):
    customers, suppliers = V._read(s, d, "customer"), V._read(s, d, "supplier")
    names = suppliers.select(F.col("s_name").alias("name")).unionByName(customers.select(F.lower("c_name").alias("name")))
    aliases = customers.select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("gene_id")).unionByName(suppliers.select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("gene_id")))
    return tools.resolved(names, aliases)


ANNOTATION = """ann AS (SELECT 'gene' AS feature, _ord AS gene_id, name, chrom, initial, final, orientation FROM genes
  UNION ALL SELECT 'exon', _ord // 10000000000 % (SELECT count(*) FROM part), name, chrom, initial, final, orientation FROM reads),
alias AS (SELECT upper(p_name) AS a, p_partkey AS gene_id FROM part UNION SELECT 'G' || p_partkey, p_partkey FROM part),
wanted AS (SELECT lower(p_name) AS name FROM part WHERE p_size > 20 UNION ALL SELECT s_name FROM supplier UNION ALL SELECT 'g' || c_custkey FROM customer),
ids AS (SELECT gene_id, min(name) AS name FROM wanted JOIN alias ON upper(name) = a GROUP BY gene_id)"""


def annotation(s, d):
    """Parts as genes, order lines as exons of them; names and aliases from parts, suppliers and customers."""
    parts = V._read(s, d, "part")
    n = parts.agg(F.count(F.lit(1)).alias("n"))
    site = ("name", *COLS, "orientation")
    genes = V.genes(s, d).select(F.lit("gene").alias("feature"), F.col("_ord").alias("gene_id"), *site)
    exons = V.reads(s, d).crossJoin(n).select(F.lit("exon").alias("feature"), (F.floor(F.col("_ord") / (10 * V.LINE)) % F.col("n")).alias("gene_id"), *site)  # one row
    aliases = parts.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("gene_id")).unionByName(parts.select(F.concat(F.lit("G"), "p_partkey").alias("alias"), F.col("p_partkey").alias("gene_id")))
    wanted = parts.filter("p_size > 20").select(F.lower("p_name").alias("name")).unionByName(V._read(s, d, "supplier").select(F.col("s_name").alias("name"))).unionByName(V._read(s, d, "customer").select(F.concat(F.lit("g"), "c_custkey").alias("name")))
    return genes.unionByName(exons), wanted, aliases


@query(f""", {ANNOTATION} SELECT gene_id, ids.name, chrom, CASE WHEN orientation = '+' THEN initial - 1000 ELSE final - 1 - 50 END AS initial, CASE WHEN orientation = '+' THEN initial + 1 + 50 ELSE final - 50 + 1000 END AS final
FROM ann JOIN ids USING (gene_id) WHERE feature = 'gene'""")
def promoters_of_gene_set(s, d):
    rows, wanted, aliases = annotation(s, d)
    return tools.annotation_promoters(rows, 1000, 50, "gene", wanted, aliases).select("gene_id", "name", *COLS)


@query(f", {ANNOTATION} SELECT gene_id, ids.name, chrom, initial, final, orientation FROM ann JOIN ids USING (gene_id) WHERE feature = 'exon'")
def exons_of_gene_set(s, d):
    return tools.annotated(annotation(s, d)[0], "exon", *annotation(s, d)[1:]).select("gene_id", "name", *COLS, "orientation")


@query(f", {ANNOTATION} SELECT name FROM wanted WHERE upper(name) NOT IN (SELECT a FROM alias)")
def unmapped_names(s, d):
    _, wanted, aliases = annotation(s, d)
    return tools.unmapped(wanted, aliases)


@query("SELECT p_partkey FROM part WHERE (p_type ILIKE '%promo%' OR p_type ILIKE '%MALL%') AND p_brand ILIKE '%1%'")
def metadata_filter(s, d):
    rows = tools.matches(V._read(s, d, "part"), {"p_type": ["promo", "MALL"], "p_brand": ["1"]}, "inexact")
    return rows.select("p_partkey")


def _left(rel: str, cut: str) -> str:
    """Merged rel less merged cut, by positions: steps of both sets, the stretches where only rel is on."""
    return f"""(SELECT chrom, pos AS initial, nx AS final FROM (SELECT chrom, pos, lead(pos) OVER w AS nx, sum(x) OVER w AS x, sum(y) OVER w AS y FROM (
      SELECT chrom, pos, sum(x) AS x, sum(y) AS y FROM (SELECT chrom, initial AS pos, 1 AS x, 0 AS y FROM {rel} UNION ALL SELECT chrom, final, -1, 0 FROM {rel} UNION ALL SELECT chrom, initial, 0, 1 FROM {cut} UNION ALL SELECT chrom, final, 0, -1 FROM {cut}) GROUP BY ALL)
      WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE x > 0 AND y = 0)"""


@query(f""", gx AS (SELECT chrom, initial, final FROM genes UNION ALL SELECT chrom, initial, final FROM reg_a)
SELECT 'exon' AS feature, sum(final - initial)::BIGINT AS bp FROM {isl('reg_a')} UNION ALL SELECT 'intron', sum(final - initial)::BIGINT FROM {_left('genes', 'reg_a')} UNION ALL SELECT 'intergenic', sum(final - initial)::BIGINT FROM {_left('chroms', 'gx')}""")
def feature_classes(s, d):
    rows = tools.feature_classes(V.genes(s, d), V.reg_a(s, d), V.sizes(s, d))
    return rows.groupBy("feature").agg(F.sum(F.col("final") - F.col("initial")).alias("bp"))


@query("SELECT p_partkey, greatest(p_size, p_retailprice / 20) > 60 AS high_max, least(p_size, p_retailprice / 20) > 20 AS high_min, (p_size + p_retailprice / 20) / 2 > 40 AS high_mean FROM part")
def expression_split(s, d):
    rows = V._read(s, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 20).alias("e"))
    pick = lambda how, cut: tools.divided(rows, ["p_size", "e"], cut, how).alias(f"high_{how}")
    return rows.select("p_partkey", pick("max", 60), pick("min", 20), pick("mean", 40))


@query("""SELECT chrom || chr(9) || 'bed' || chr(9) || 'region' || chr(9) || (initial + 1) || chr(9) || final || chr(9) || '.' || chr(9) || orientation || chr(9) || '.' || chr(9) || 'gene_id "' || name || '"; transcript_id "' || name || '";' AS line FROM genes""")
def gtf_lines(s, d):
    return V.genes(s, d).select(tools.gtf_line(F.lit("region")).alias("line"))


@query("""SELECT name, round(log2(x) - log2(y), 5) + 0.0 AS m, round((log2(x) + log2(y)) / 2, 5) AS a, round(log2(x * 0.5) - log2(y * 2), 5) + 0.0 AS m_norm, round((log2(x * 0.5) + log2(y * 2)) / 2, 5) AS a_norm
FROM (SELECT name, nullif(count(*) FILTER (orientation = '+'), 0) AS x, nullif(count(*) FILTER (orientation = '-'), 0) AS y FROM reads GROUP BY name)""")
def scaled_fold_changes(s, d):
    rows = V.reads(s, d).groupBy("name").agg(F.count_if(F.col("orientation") == "+").alias("x"), F.count_if(F.col("orientation") == "-").alias("y"))
    out = tools.fold_changes(rows, "x", "y", F.lit(0.5), F.lit(2.0))
    return out.select("name", *((F.round(c, 5) + 0.0).alias(c) for c in ("m", "a", "m_norm", "a_norm")))


@query("SELECT (final - initial) // 20 * 20 AS size, orientation, count(*) AS n FROM reg_a GROUP BY ALL")
def size_histogram(s, d):
    size = (F.floor((F.col("final") - F.col("initial")) / 20) * 20).alias("size")
    return V.reg_a(s, d).groupBy(size, "orientation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS records, sum(length(seq))::BIGINT AS letters FROM dna")
def sequence_totals(s, d):
    return V.dna(s, d).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("seq")).alias("letters"))


@query("SELECT doc_id, substr(seq, 11, 30) AS slice, reverse(substr(seq, 11, 30)) AS backward, translate(substr(seq, 11, 30), 'ACGT', 'TGCA') AS complement FROM dna")
def sequence_slices(s, d):
    cut = F.substring("seq", 11, 30)
    return V.dna(s, d).select("doc_id", cut.alias("slice"), F.reverse(cut).alias("backward"), F.translate(cut, "ACGT", "TGCA").alias("complement"))
