"""Queries of corrections, gene sets, names, peaks and everyday tools, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peaks, stats, tools
from ..operators.islands import merge
from . import views as V
from .catalog import COLS, OV, isl, query

P = "(SELECT _ord, CASE WHEN score = 50 THEN NULL ELSE pow((((_ord % 100003 * 7919) % 100003) + 1) / 100004.0::DOUBLE, 4) END AS p FROM reg_a)"


def tests(s, d):
    """Made-up p values that crowd near 0, some missing."""
    p = F.pow((((F.col("_ord") % 100003 * 7919) % 100003) + 1) / F.lit(100004.0), F.lit(4.0))
    return V.reg_a(s, d).select("_ord", F.when(F.col("score") != 50, p).alias("p"))


@query(f"""SELECT _ord, round(q, 6) AS q, coalesce(q <= 0.05, false) AS rejected FROM (SELECT _ord, CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (ORDER BY p DESC NULLS LAST)) END AS q FROM (
  SELECT _ord, p, p * n / count(p) OVER (ORDER BY p NULLS LAST) * (SELECT sum(1.0::DOUBLE / k) FROM range(1, (SELECT count(p) FROM {P})::BIGINT + 1) t(k)) AS raw FROM (SELECT *, count(p) OVER () AS n FROM {P})))""")
def by_correction(s, d):
    return stats.corrected(tests(s, d), "p", 0.05, dependent=True).select("_ord", F.round("q", 6).alias("q"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


@query(f"SELECT _ord, coalesce(q <= 0.05, false) AS rejected FROM (SELECT _ord, CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (ORDER BY p DESC NULLS LAST)) END AS q FROM (SELECT _ord, p, p * n / count(p) OVER (ORDER BY p NULLS LAST) AS raw FROM (SELECT *, count(p) OVER () AS n FROM {P})))")
def bh_rejections(s, d):
    return stats.corrected(tests(s, d), "p").select("_ord", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def _bp(a: str) -> str:
    return f"""SELECT a - c AS a_only_bp, b - c AS b_only_bp, c AS both_bp FROM (SELECT sum(final - initial)::BIGINT AS a FROM {isl(a)}), (SELECT sum(final - initial)::BIGINT AS b FROM {isl('reg_b')}),
(SELECT sum(least(a.final, b.final) - greatest(a.initial, b.initial))::BIGINT AS c FROM {isl(a)} a JOIN {isl('reg_b')} b ON {OV})"""


@query(_bp("reg_a"))
def intersect_positions(s, d):
    return stats.intersect_bp(V.reg_a(s, d), V.reg_b(s, d))


@query(", small AS (SELECT * FROM (SELECT _ord, chrom, initial + trunc((final - initial) * 50 / 200)::BIGINT AS initial, final - trunc((final - initial) * 50 / 200)::BIGINT AS final FROM reg_a) WHERE initial < final) " + _bp("small"))
def intersect_positions_shrunk(s, d):
    return stats.intersect_bp(V.reg_a(s, d), V.reg_b(s, d), 50)


NAMES = "(SELECT DISTINCT upper('p' || (p_partkey % 9)) FROM part)"


@query(f"SELECT _ord, name FROM reg_a WHERE upper(name) NOT IN {NAMES}")
def names_outside(s, d):
    return tools.by_names(V.reg_a(s, d), _wanted(s, d), outside=True).select("_ord", "name")


@query("SELECT _ord, w.score FROM reg_a JOIN (SELECT upper('p' || (p_partkey % 9)) AS w, max(p_size)::BIGINT AS score FROM part GROUP BY 1) w ON upper(name) = w")
def names_with_scores(s, d):
    return tools.by_names(V.reg_a(s, d), _wanted(s, d), score="score").select("_ord", "score")


def _wanted(s, d):
    return V._read(s, d, "part").groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 9).cast("string")).alias("name")).agg(F.max("p_size").cast("bigint").alias("score"))


@query("SELECT upper(name) || score AS gene FROM genes WHERE upper(name) || score NOT IN (SELECT upper(name) || score FROM genes WHERE score < 25)")
def gene_set_subtract(s, d):
    g = V.genes(s, d).select(F.concat(F.upper("name"), F.col("score").cast("string")).alias("gene"), "score")
    return tools.gene_subtract(g.select("gene"), g.filter("score < 25").select("gene"))


@query("SELECT chrom, initial, final, TRY_CAST(any_value(name_ || score) AS DOUBLE) AS score FROM (SELECT *, CASE WHEN score > 25 THEN '' ELSE 'x' END AS name_ FROM genes) GROUP BY chrom, initial, final")
def score_table(s, d):
    g = V.genes(s, d).withColumn("data", F.concat(F.when(F.col("score") > 25, "").otherwise("x"), F.col("score").cast("string")))
    return tools.scores(g)


@query("SELECT true AS stranded")
def is_stranded(s, d):
    return tools.is_stranded(V.reg_a(s, d))


@query("SELECT _ord, chrom FROM reg_a WHERE regexp_full_match(chrom, 'chr([1-9]|1[0-9]|X|Y)')")
def standard_contigs(s, d):
    return tools.standard_contigs(V.reg_a(s, d), 19).select("_ord", "chrom")


@query("SELECT _ord, CASE WHEN score > 25 THEN 'chr' || substr(chrom, 4) ELSE chrom END AS chrom FROM genes")
def prefixed_contigs(s, d):
    g = V.genes(s, d).withColumn("chrom", F.when(F.col("score") > 25, F.expr("substr(chrom, 4)")).otherwise(F.col("chrom")))
    return tools.prefixed(g, "chr").select("_ord", "chrom")


@query(f"""SELECT w._ord, count(*) AS n, count(*) FILTER (r.score > 40) AS tails FROM (SELECT _ord, chrom, CASE WHEN orientation = '+' THEN final - 100 ELSE initial - 50 END AS initial, CASE WHEN orientation = '+' THEN final + 50 ELSE initial + 100 END AS final, orientation FROM genes) w
JOIN reads r ON w.chrom = r.chrom AND w.initial < r.final AND r.initial < w.final AND w.orientation = r.orientation GROUP BY w._ord""")
def tail_counts(s, d):
    return tools.tail_counts(V.genes(s, d), V.reads(s, d).withColumn("tail", F.col("score") > 40), 100, 50)


@query("SELECT chrom, initial // 10 * 10 AS at, score FROM reads JOIN (SELECT chrom, 500000 + 20000 * substr(chrom, 4)::BIGINT AS length FROM chroms) USING (chrom) WHERE initial // 10 * 10 + 10 <= length")
def trimmed_points(s, d):
    points = V.reads(s, d).select("chrom", (F.floor(F.col("initial") / 10) * 10).alias("at"), "score")
    sizes = V.sizes(s, d).withColumn("length", 500000 + 20000 * F.expr("substr(chrom, 4)").cast("bigint"))
    return tools.trim_points(points, sizes, 10)


PEAKS = """peaks AS (SELECT _ord, chrom, initial, final, orientation, score + 1 AS plus, (score * 7) % 50 + 1 AS minus, pow((((_ord % 100003 * 7919) % 100003) + 1) / 100004.0::DOUBLE, 3) AS p FROM reg_a)"""


def made_peaks(s, d, *more):
    p = F.pow((((F.col("_ord") % 100003 * 7919) % 100003) + 1) / F.lit(100004.0), F.lit(3.0))
    return V.reg_a(s, d).select("_ord", *COLS, "orientation", (F.col("score") + 1).alias("plus"), ((F.col("score") * 7) % 50 + 1).alias("minus"), p.alias("p"), *more)


@query(f""", {PEAKS}, z AS (SELECT *, (ln(plus / minus) - avg(ln(plus / minus)) OVER ()) / stddev_pop(ln(plus / minus)) OVER () AS z, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM peaks),
q AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC)) AS q FROM z) SELECT _ord, round(q, 6) AS q, round(z, 5) + 0.0 AS z FROM q WHERE q <= 0.4 AND abs(z) < 2""")
def filtered_peaks(s, d):
    return peaks.filter_strand_lag(made_peaks(s, d), 0.4).select("_ord", F.round("q", 6).alias("q"), (F.round("z", 5) + 0.0).alias("z"))


@query(f""", {PEAKS}, k AS (SELECT *, CASE WHEN plus >= 2 * minus THEN 'gain' ELSE 'lose' END AS kind FROM peaks WHERE plus >= 2 * minus OR minus >= 2 * plus)
SELECT chrom, kind, initial, final, n FROM {isl('k', 500, 'chrom, kind')}""")
def split_peaks(s, d):
    return peaks.split_by_fold(made_peaks(s, d), 2.0, 500)


@query(f""", {PEAKS}, l AS (SELECT peaks._ord, peaks.chrom, peaks.initial, peaks.final, peaks.orientation, reg_a.name, -log10(p) AS lp FROM peaks JOIN reg_a USING (_ord)),
m AS (SELECT a._ord, b._ord AS o2, a.chrom, a.orientation, a.initial, a.final, a.name || ':' || b.name AS name, greatest(greatest(a.lp, b.lp) - log10(2), least(a.lp, b.lp)) AS lp FROM l a JOIN l b ON {OV} AND a._ord % 2 = 0 AND b._ord % 2 = 1),
c AS (SELECT *, sum(ch) OVER (PARTITION BY chrom ORDER BY initial, final, _ord, o2) AS run FROM (SELECT *, CASE WHEN lag(orientation) OVER (PARTITION BY chrom ORDER BY initial, final, _ord, o2) = orientation THEN 0 ELSE 1 END AS ch FROM m)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY chrom, run ORDER BY initial, final, _ord, o2) AS g FROM (SELECT *, CASE WHEN pm IS NULL OR initial >= pm THEN 1 ELSE 0 END AS nw FROM (SELECT *, max(final) OVER (PARTITION BY chrom, run ORDER BY initial, final, _ord, o2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM c)))
SELECT chrom, any_value(orientation) AS orientation, min(initial) AS initial, max(final) AS final, first(name ORDER BY initial, final, _ord, o2) AS name,
  round(list_reduce(list(lp ORDER BY initial, final, _ord, o2), lambda a, x: greatest(greatest(a, x) - log10(2), least(a, x))), 5) AS p FROM i GROUP BY chrom, run, g""")
def combined_peaks(s, d):
    rows = made_peaks(s, d, "name").withColumn("p", -F.log10("p"))
    return peaks.combined(rows.filter("_ord % 2 = 0"), rows.filter("_ord % 2 = 1")).withColumn("p", F.round("p", 5))


@query("SELECT mask, count(*) AS n FROM (SELECT chrom, initial, final, sum(DISTINCT b)::BIGINT AS mask FROM (SELECT chrom, initial, final, 1 AS b FROM reg_a UNION ALL SELECT chrom, initial, final, 2 FROM reads UNION ALL SELECT chrom, initial, final, 4 FROM genes) GROUP BY ALL) GROUP BY mask")
def union_of_sets(s, d):
    """Distinct places of all sets, and which sets each comes from."""
    every = tools.combined_sets({"a": V.reg_a(s, d), "b": V.reads(s, d), "c": V.genes(s, d)})
    mask = sum((F.when(F.array_contains("sets", n), 1 << i).otherwise(0) for i, n in enumerate("abc")), F.lit(0))
    return every.groupBy(mask.cast("bigint").alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT mu, alpha, round(1 / alpha, 6) AS n, round(1 / (1 + mu * alpha), 6) AS p FROM (SELECT DISTINCT score::DOUBLE AS mu, score / 100.0::DOUBLE AS alpha FROM reg_a)")
def negative_binomial_parameters(s, d):
    rows = V.reg_a(s, d).select(F.col("score").cast("double").alias("mu"), (F.col("score") / F.lit(100.0)).alias("alpha")).distinct()
    n, p = peaks.negative_binomial_parameters(F.col("mu"), F.col("alpha"))
    return rows.select("mu", "alpha", F.round(n, 6).alias("n"), F.round(p, 6).alias("p"))


@query(f"SELECT chrom, count(*) AS islands FROM {isl('reg_a')} GROUP BY chrom")
def islands_per_chromosome(s, d):
    return merge(V.reg_a(s, d)).groupBy("chrom").agg(F.count(F.lit(1)).alias("islands"))
