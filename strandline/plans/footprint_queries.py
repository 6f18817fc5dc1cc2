"""Queries of bias-corrected cut signals, position-matrix bias and signals by fragment length, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import footprint, tools
from . import views as V
from .catalog import query
from .cut_queries import AT, WINDOWS, windows
from .tool_queries import SIZE, dna_regions

K = 6
#: The bias table of cut_kmer_bias, unrounded.
BIAS = f"""p AS (SELECT doc_id, orientation, position, least(count(*), 100) AS n FROM {AT} GROUP BY ALL), o AS (SELECT orientation, kmer, sum(n) AS n FROM (SELECT orientation, substr(seq, (position - 3 + 1)::INT, 6) AS kmer, n FROM p JOIN dna USING (doc_id) WHERE position >= 3) WHERE length(kmer) = 6 GROUP BY orientation, kmer),
e AS (SELECT kmer, count(*) AS a FROM (SELECT unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM dna WHERE length(seq) >= 6) GROUP BY kmer),
b AS (SELECT orientation, kmer, coalesce(n, 0) + 1 AS o, a + 1 AS e FROM (SELECT *, unnest(['+', '-']) AS orientation FROM e) LEFT JOIN o USING (orientation, kmer)),
kb AS (SELECT orientation, kmer, (o / sum(o) OVER (PARTITION BY orientation)) / (e / sum(e) OVER (PARTITION BY orientation)) AS bias FROM b)"""


def placed_cuts(s, d):
    """Cuts (doc_id, orientation, position) on the letters of the documents."""
    n = V._read(s, d, "documents").agg(F.count(F.lit(1)).alias("docs"))
    li = V._read(s, d, "lineitem").crossJoin(n)  # one row
    return li.select((F.col("l_orderkey") % F.col("docs")).alias("doc_id"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("orientation"), (F.col("l_partkey") % 400).alias("position"))


@query(f""", {BIAS}, r AS (SELECT doc_id, doc_id % 150 AS initial, doc_id % 150 + 20 + doc_id % 70 AS final FROM dna),
pos AS (SELECT doc_id, initial, final, o, initial + o AS x FROM (SELECT *, unnest(range(-25, final - initial + 25)) AS o FROM r)),
km AS (SELECT doc_id, o, x, CASE WHEN x >= 3 THEN substr(seq, (x - 3 + 1)::INT, 6) END AS f, CASE WHEN x >= 2 THEN reverse(translate(substr(seq, (x - 2 + 1)::INT, 6), 'ACGT', 'TGCA')) END AS g FROM pos JOIN dna USING (doc_id)),
cut AS (SELECT doc_id, position AS x, count(*) FILTER (orientation = '+') AS nf, count(*) FILTER (orientation = '-') AS nr FROM {AT} GROUP BY ALL),
v AS (SELECT km.doc_id, o, coalesce(f.bias, 1) AS af, coalesce(g.bias, 1) AS ar, coalesce(nf, 0) AS nf, coalesce(nr, 0) AS nr FROM km LEFT JOIN kb f ON f.orientation = '+' AND f.kmer = km.f LEFT JOIN kb g ON g.orientation = '-' AND g.kmer = km.g LEFT JOIN cut USING (doc_id, x)),
w AS (SELECT *, sum(af) OVER t AS sf, sum(ar) OVER t AS sr, sum(nf) OVER t AS cf, sum(nr) OVER t AS cr FROM v WINDOW t AS (PARTITION BY doc_id ORDER BY o ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))
SELECT doc_id AS _ord, o AS place, round(CASE WHEN initial - 28 <= 0 THEN nf + nr ELSE ln(nf + 1) - ln(cf * (af / sf) + 1) + ln(nr + 1) - ln(cr * (ar / sr) + 1) END, 5) AS signal FROM w JOIN r USING (doc_id) WHERE o >= 0 AND o < final - initial""")
def bias_corrected_signals(s, d):
    """Regions on each document's letters; those that begin within 28 of the start keep their plain counts."""
    at = placed_cuts(s, d)
    table = C.kmer_bias(at, V.dna(s, d), "doc_id", K)
    cut = at.select(F.col("doc_id").cast("string").alias("chrom"), F.col("position").alias("initial"), (F.col("position") + 1).alias("final"), "orientation")
    genome = V.dna(s, d).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    out = footprint.bias_corrected(dna_regions(s, d), cut, tools.chunked(genome, SIZE), SIZE, table)
    return out.select("_ord", F.col("offset").alias("place"), F.round("signal", 5).alias("signal"))


COUNTS = f"""q AS (SELECT doc_id, orientation, position, least(count(*), 101) AS n FROM {AT} GROUP BY ALL),
km AS (SELECT orientation, n, substr(seq, (position - 3 + 1)::INT, 6) AS kmer FROM q JOIN dna USING (doc_id) WHERE position >= 3),
ob AS (SELECT orientation, n, CASE WHEN orientation = '-' THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END AS kmer FROM km WHERE length(kmer) = 6),
ex AS (SELECT orientation, CASE WHEN orientation = '-' THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END AS kmer, n FROM (SELECT kmer, count(*) AS n FROM (SELECT unnest([substr(seq, i, 6) for i in range(1, length(seq) - 5)]) AS kmer FROM dna WHERE length(seq) > 6) GROUP BY kmer), (VALUES ('+'), ('-')) t(orientation)),
pc AS (SELECT kind, orientation, place, substr(kmer, (place + 1)::INT, 1) AS letter, sum(n)::BIGINT AS n FROM (SELECT 'observed' AS kind, * FROM ob UNION ALL BY NAME SELECT 'expected' AS kind, * FROM ex), range(0, 6) t(place) GROUP BY ALL)"""


def letter_counts(s, d):
    return footprint.position_counts(placed_cuts(s, d), V.dna(s, d), "doc_id", K)


@query(f", {COUNTS} SELECT kind, orientation, place, letter, n FROM pc")
def cut_position_counts(s, d):
    return letter_counts(s, d).withColumn("place", F.col("place").cast("bigint"))


@query(f""", {COUNTS}, sh AS (SELECT orientation, place, letter, (sum(n) FILTER (kind = 'observed')) / sum(sum(n) FILTER (kind = 'observed')) OVER u AS o, (sum(n) FILTER (kind = 'expected')) / sum(sum(n) FILTER (kind = 'expected')) OVER u AS e
  FROM pc WHERE letter IN ('A', 'C', 'G', 'T') GROUP BY orientation, place, letter WINDOW u AS (PARTITION BY orientation, place)),
words AS (SELECT list_aggregate([substr('ACGT', ((id // pow(4, 5 - i)::BIGINT) % 4 + 1)::INT, 1) for i in range(6)], 'string_agg', '') AS kmer FROM range(0, 4096) t(id))
SELECT orientation, kmer, round(product(o) / product(e), 6) AS bias FROM words, range(0, 6) t(p) JOIN sh ON place = p AND letter = substr(kmer, (p + 1)::INT, 1) GROUP BY orientation, kmer""")
def cut_position_bias(s, d):
    return footprint.position_bias(letter_counts(s, d), K)


FRAGMENTS = {"short": (None, 40), "middle": (40, 80), "long": (80, None), "all": (None, None)}


@query(f""", {WINDOWS}, f AS (SELECT *, abs(score * 4 - 100) AS size, CASE WHEN orientation = '-' THEN final - 6 ELSE initial + 4 END AS pos FROM reads),
k AS (SELECT *, unnest(list_filter([CASE WHEN size <= 40 THEN 'short' END, CASE WHEN size BETWEEN 40 AND 80 THEN 'middle' END, CASE WHEN size > 80 THEN 'long' END, 'all'], lambda c: c IS NOT NULL)) AS class FROM f)
SELECT w._ord, class, k.orientation, pos - w.initial AS place, count(*) AS n FROM win w JOIN k ON w.chrom = k.chrom AND pos >= w.initial AND pos < w.final GROUP BY ALL""")
def fragment_class_signals(s, d):
    """Cuts around genes by four classes of fragment length; a length of 40 is in two of them besides all."""
    reads = V.reads(s, d).withColumn("template", F.col("score") * 4 - 100)
    return footprint.fragment_signals(windows(s, d), reads, FRAGMENTS, 4, -5).withColumnRenamed("offset", "place")
