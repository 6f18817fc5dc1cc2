"""Queries of cut sites and their signals, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import project
from . import views as V
from .catalog import query

CUTS = "cuts AS (SELECT chrom, orientation, CASE WHEN orientation = '-' THEN final - 6 ELSE initial + 4 END AS pos FROM reads)"
WINDOWS = "win AS (SELECT _ord, chrom, greatest((initial + final) // 2 - 50, 0) AS initial, (initial + final) // 2 + 50 AS final FROM genes)"
PILED = f"{CUTS}, {WINDOWS}, piled AS (SELECT w._ord, pos - w.initial AS place, count(*) AS n FROM win w JOIN cuts c ON w.chrom = c.chrom AND pos >= w.initial AND pos < w.final GROUP BY ALL)"
ARRAYS = f"""{PILED}, dense AS (SELECT _ord, list(coalesce(n, 0)::DOUBLE ORDER BY p) AS x FROM (SELECT _ord, unnest(range(0, final - initial)) AS p FROM win) LEFT JOIN (SELECT _ord, place AS p, n FROM piled) USING (_ord, p) GROUP BY _ord)"""


def windows(s, d):
    return project.relocate(V.genes(s, d), "midpoint", 50, 50)


def cuts(s, d):
    return C.cut_sites(V.reads(s, d), 4, -5)


def signals(s, d):
    return C.dense(windows(s, d), C.pileup(windows(s, d), cuts(s, d)))


@query(f", {CUTS}, {WINDOWS} SELECT w._ord, c.orientation, pos - w.initial AS place, count(*) AS n FROM win w JOIN cuts c ON w.chrom = c.chrom AND pos >= w.initial AND pos < w.final GROUP BY ALL")
def cut_pileup(s, d):
    return C.pileup(windows(s, d), cuts(s, d), ("orientation",)).withColumnRenamed("offset", "place")


@query(f", {ARRAYS} SELECT _ord, list_sum(x) AS cuts, len(x) AS n, list_max(x) AS top FROM dense")
def cut_signals(s, d):
    total = F.aggregate("signal", F.lit(0.0), lambda a, v: a + v)
    return signals(s, d).select("_ord", total.alias("cuts"), F.size("signal").cast("bigint").alias("n"), F.array_max("signal").alias("top"))


@query(f""", {ARRAYS}, y AS (SELECT _ord, [least(v, 2.0) for v in x] AS y FROM dense), z AS (SELECT _ord, y, list_avg(y) + 3 * list_stddev_pop(y) AS top FROM y)
SELECT _ord, round(list_sum([least(v, top) for v in y]), 6) AS total FROM z""")
def clipped_signals(s, d):
    total = F.aggregate(C.clipped(F.col("signal"), 2, 3), F.lit(0.0), lambda a, v: a + v)
    return signals(s, d).select("_ord", F.round(total, 6).alias("total"))


@query(f""", {ARRAYS}, y AS (SELECT _ord, x, list_aggregate(x, 'quantile_cont', 0.98) AS q, list_stddev_pop(x) AS sd FROM dense)
SELECT _ord, round(q, 6) AS q, round(CASE WHEN sd > 0 THEN list_sum([CASE WHEN v = 0 THEN 0 ELSE 1 / (1 + exp(-(v - q) / sd)) END for v in x]) ELSE list_sum(x) END, 6) AS total FROM y""")
def normalised_signals(s, d):
    total = F.aggregate(C.between_sets(F.col("signal"), 98), F.lit(0.0), lambda a, v: a + v)
    return signals(s, d).select("_ord", F.round(C.percentile(F.col("signal"), 98), 6).alias("q"), F.round(total, 6).alias("total"))


@query(f""", {ARRAYS}, c AS (SELECT _ord, [v - list_avg(x) for v in x] AS x FROM dense), y AS (SELECT _ord, x, list_aggregate(x, 'quantile_cont', 0.98) AS q, list_stddev_pop(x) AS sd FROM c)
SELECT _ord, round(CASE WHEN sd > 0 THEN list_sum([CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN 1 / (1 + exp(-(v - q) / sd)) ELSE -1 / (1 + exp(-(-v - q) / sd)) END for v in x]) ELSE list_sum(x) END, 5) AS total FROM y""")
def signed_normalised_signals(s, d):
    """Signals less their mean, so that both signs occur."""
    centred = C.let(F.col("signal"), lambda x: C.let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x), lambda m: F.transform(x, lambda v: v - m)))
    total = F.aggregate(C.between_sets(F.col("x"), 98, signed=True), F.lit(0.0), lambda a, v: a + v)
    return signals(s, d).select("_ord", centred.alias("x")).select("_ord", F.round(total, 5).alias("total"))


@query(f""", {ARRAYS}, e AS (SELECT _ord, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM dense), r AS (SELECT *, row_number() OVER (PARTITION BY _ord ORDER BY v DESC, i) AS k FROM e),
m AS (SELECT _ord, i, avg(CASE WHEN k > 4 THEN v END) OVER (PARTITION BY _ord ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM r) SELECT _ord, round(sum(s), 6) AS total, count(s) AS n FROM m GROUP BY _ord""")
def masked_smooth(s, d):
    rows = signals(s, d).select("_ord", F.filter(C.masked_mean(F.col("signal")), lambda v: v.isNotNull()).alias("y"))
    return rows.select("_ord", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("y").cast("bigint").alias("n"))


AT = "(SELECT l_orderkey % (SELECT count(*) FROM documents) AS doc_id, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS orientation, l_partkey % 400 AS position FROM lineitem)"


@query(f""", p AS (SELECT doc_id, orientation, position, least(count(*), 100) AS n FROM {AT} GROUP BY ALL), o AS (SELECT orientation, kmer, sum(n) AS n FROM (SELECT orientation, substr(seq, (position - 3 + 1)::INT, 6) AS kmer, n FROM p JOIN dna USING (doc_id) WHERE position >= 3) WHERE length(kmer) = 6 GROUP BY orientation, kmer),
e AS (SELECT kmer, count(*) AS a FROM (SELECT unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM dna WHERE length(seq) >= 6) GROUP BY kmer),
b AS (SELECT orientation, kmer, coalesce(n, 0) + 1 AS o, a + 1 AS e FROM (SELECT *, unnest(['+', '-']) AS orientation FROM e) LEFT JOIN o USING (orientation, kmer))
SELECT orientation, kmer, o::BIGINT AS observed, e AS expected, round((o / sum(o) OVER (PARTITION BY orientation)) / (e / sum(e) OVER (PARTITION BY orientation)), 5) AS bias FROM b""")
def cut_kmer_bias(s, d):
    n = V._read(s, d, "documents").agg(F.count(F.lit(1)).alias("docs"))
    li = V._read(s, d, "lineitem").crossJoin(n)  # one row
    at = li.select((F.col("l_orderkey") % F.col("docs")).alias("doc_id"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("orientation"), (F.col("l_partkey") % 400).alias("position"))
    return C.kmer_bias(at, V.dna(s, d), "doc_id", 6).withColumn("bias", F.round("bias", 5))
