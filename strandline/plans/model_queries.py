"""Queries of hidden Markov models, normalisation, differential peaks and footprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..lineage import written
from ..operators import hmm, peaks
from . import views as V
from .catalog import OV, isl, query
from .signal_queries import BINS, bins


def two_samples(s, d):
    """(chrom, bin, x, y): rows of both sets in bins of 1,000; a bin missing on a side counts 0 there."""
    a, b = bins(V.reg_a(s, d)).withColumnRenamed("value", "x"), bins(V.reg_b(s, d)).withColumnRenamed("value", "y")
    return a.join(b, ["chrom", "bin"], "full").fillna(0, ["x", "y"])


TWO = f"{BINS}, two AS (SELECT chrom, bin, coalesce(x.value, 0) AS x, coalesce(y.value, 0) AS y FROM x FULL JOIN y USING (chrom, bin))"


def labelled(s, d):
    """Bins with a state: 1 if the first sample has at least twice the second, 2 the other way, else 0."""
    return two_samples(s, d).withColumn("state", F.when(F.col("x") >= 2 * F.col("y"), 1).when(F.col("y") >= 2 * F.col("x"), 2).otherwise(0))


LABELLED = f"{TWO}, lab AS (SELECT *, CASE WHEN x >= 2 * y THEN 1 WHEN y >= 2 * x THEN 2 ELSE 0 END AS state FROM two)"


@query(f", {LABELLED}, n AS (SELECT a.state, b.state AS next, count(*) AS n FROM lab a JOIN lab b ON a.chrom = b.chrom AND b.bin = a.bin + 1 GROUP BY ALL) SELECT state, next, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM n")
def state_transitions(s, d):
    return hmm.transitions(labelled(s, d), "chrom", "bin", "state").withColumn("p", F.round("p", 6))


@query(f", {LABELLED} SELECT state, count(*) AS n, round(avg(x), 5) AS mean_x, round(avg(y), 5) AS mean_y, round(var_samp(x), 5) AS var_x, round(var_samp(y), 5) AS var_y, round(covar_samp(x, y), 5) + 0.0 AS cov FROM lab GROUP BY state")
def state_emissions(s, d):
    r = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return hmm.emissions(labelled(s, d), "state", "x", "y").select("state", "n", *map(r, ("mean_x", "mean_y", "var_x", "var_y", "cov")))


def three_states():
    """Background, gain in the first sample, gain in the second."""
    return hmm.Model(np.array([0.8, 0.1, 0.1]), np.array([[0.9, 0.05, 0.05], [0.1, 0.85, 0.05], [0.1, 0.05, 0.85]]), (((1.0, 1.0), 0.2), ((3.0, 1.0), 0.2), ((1.0, 3.0), 0.2)), hmm.negative_binomial)


def planted(s, d):
    """two_samples over every bin of every chromosome, with enriched stretches of several widths: 12 more in x at some, in y at others."""
    every = V.sizes(s, d).select("chrom", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 1000) - 1)).alias("bin"))
    two = every.join(two_samples(s, d), ["chrom", "bin"], "left").fillna(0, ["x", "y"])
    more = lambda period, at, widths: F.when((F.col("bin") % period).between(at, at + F.floor(F.col("bin") / period) % widths), 12).otherwise(0)
    return two.withColumns({"x": F.col("x") + more(47, 3, 5), "y": F.col("y") + more(61, 10, 4)})


@query()
def differential_states(s, d):
    """Two rounds of fitting over all bins, then the likeliest path."""
    two = written(planted(s, d))
    model, _ = hmm.fit(two, "chrom", "bin", ["x", "y"], three_states(), 2, (np.array([0, 2, 1]), np.array([1, 0])))
    return hmm.decode(two, "chrom", "bin", ["x", "y"], model)


@query()
def differential_peaks(s, d):
    two = planted(s, d)
    states = hmm.decode(two, "chrom", "bin", ["x", "y"], three_states()).join(two, ["chrom", "bin"])
    return peaks.merge_peaks(peaks.peaks(states, 1000, 0.2), 2000).withColumn("p", F.round("p", 6))


def samples(s, d):
    tag = lambda df, name: bins(df).withColumn("sample", F.lit(name))
    return tag(V.reg_a(s, d), "x").unionByName(tag(V.reg_b(s, d), "y"))


def _tmm_sql(c: str) -> str:
    return f"""SELECT '{c}' AS sample, round(pow(2, sum(m * a) / sum(a)), 6) AS factor FROM (SELECT *, quantile_cont(m, 0.2) OVER () AS m0, quantile_cont(m, 0.8) OVER () AS m1, quantile_cont(a, 0.05) OVER () AS a0, quantile_cont(a, 0.95) OVER () AS a1
  FROM (SELECT ln((x + y) / 2 / {c}) AS m, ln((x + y) / 2 * {c}) / 2 AS a FROM (SELECT * FROM two ORDER BY {c} + (x + y) / 2 DESC, chrom, bin LIMIT 10000) WHERE {c} > 0)) WHERE m BETWEEN m0 AND m1 AND a BETWEEN a0 AND a1"""


@query(f", {TWO} {_tmm_sql('x')} UNION ALL {_tmm_sql('y')}")
def trimmed_mean_factors(s, d):
    return peaks.tmm(samples(s, d), ["x", "y"]).withColumn("factor", F.round("factor", 6))


@query(f""", {BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, key) AS k FROM (SELECT 'x' AS sample, chrom || ':' || bin AS key, value FROM x UNION ALL SELECT 'y', chrom || ':' || bin, value FROM y))
SELECT sample, key, round(avg(value) OVER (PARTITION BY k), 6) AS value FROM r""")
def quantile_normalised(s, d):
    rows = samples(s, d).select("sample", F.concat_ws(":", "chrom", "bin").alias("key"), F.col("value").cast("double").alias("value"))
    return peaks.quantile_normalised(rows, "sample", "key", "value", 1).select("sample", "key", F.round("value", 6).alias("value"))


@query(f""", {TWO}, mv AS (SELECT (x + y) / 2 AS m, (x - y) * (x - y) / 4 AS v FROM two), cut AS (SELECT quantile_cont(m, 0.9975) AS cm, quantile_cont(v, 0.9975) AS cv FROM mv)
SELECT round(greatest(coalesce(sum((v - m) * m * m) / nullif(sum(m * m * m * m), 0), 0), 0), 6) AS a FROM mv, cut WHERE m < cm AND v < cv""")
def mean_variance_fit(s, d):
    m, v = (F.col("x") + F.col("y")) / 2, (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / 4
    return peaks.mean_variance(two_samples(s, d).select(m.alias("m"), v.alias("v"))).select(F.round("a", 6).alias("a"))


@query(f""", f0 AS (SELECT * FROM reg_a a WHERE EXISTS (SELECT 1 FROM genes b WHERE {OV})), f1 AS (SELECT *, 0 AS _ord FROM {isl('f0')}),
f2 AS (SELECT chrom, 0 AS _ord, CASE WHEN final - initial < 80 THEN greatest(initial - 20, 0) ELSE initial END AS initial, CASE WHEN final - initial < 80 THEN final + 20 ELSE final END AS final FROM f1), f3 AS (SELECT chrom, initial, final FROM {isl('f2')})
SELECT chrom, initial, final, (SELECT count(*) FROM reads r WHERE r.chrom = f3.chrom AND r.initial < (f3.initial + f3.final) // 2 + 100 AND greatest((f3.initial + f3.final) // 2 - 100, 0) < r.final) AS tags FROM f3""")
def footprint_tags(s, d):
    return peaks.footprints(V.reg_a(s, d), V.genes(s, d), V.reads(s, d), 80, 20, 100)


SPLIT = f"""al AS (SELECT 0 AS s, _ord, chrom, initial, final FROM reg_a UNION ALL SELECT 1, _ord, chrom, initial, final FROM reg_b),
rk AS (SELECT rep, s, _ord, chrom, initial, final, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || ':' || s || ':' || _ord || ':1')[1:12], s, _ord) AS k FROM al, range(1, 4) r(rep)),
le AS (SELECT rep || ':' || chrom AS chrom, initial, final, _ord FROM rk WHERE k <= (SELECT count(*) FROM reg_a) UNION ALL SELECT '0:' || chrom, initial, final, _ord FROM reg_a),
ri AS (SELECT rep || ':' || chrom AS chrom, initial, final, _ord FROM rk WHERE k > (SELECT count(*) FROM reg_a) UNION ALL SELECT '0:' || chrom, initial, final, _ord FROM reg_b),
ml AS {isl('le')}, mr AS {isl('ri')},
kk AS (SELECT split_part(chrom, ':', 1) AS rep, 'a' AS k FROM ml a WHERE NOT EXISTS (SELECT 1 FROM mr b WHERE {OV}) UNION ALL SELECT split_part(chrom, ':', 1), 'b' FROM mr a WHERE NOT EXISTS (SELECT 1 FROM ml b WHERE {OV})
  UNION ALL SELECT split_part(a.chrom, ':', 1), 'c' FROM ml a JOIN mr b ON {OV}),
ob AS (SELECT count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'b') AS b, count(*) FILTER (k = 'c') AS c FROM kk WHERE rep = '0'),
me AS (SELECT count(*) FILTER (k = 'a') / 3 AS a, count(*) FILTER (k = 'b') / 3 AS b, count(*) FILTER (k = 'c') / 3 AS c FROM kk WHERE rep <> '0'),
tt AS (SELECT ob.a AS oa, ob.b AS ob, ob.c AS oc, me.a AS ea, me.b AS eb, me.c AS ec, (ob.a + ob.b + ob.c)::DOUBLE AS o, (me.a + me.b + me.c)::DOUBLE AS e FROM ob, me),
ch AS (SELECT *, list_sum([pow(p.x - p.t * (p.x + p.y) / (o + e), 2) / (p.t * (p.x + p.y) / (o + e)) for p in [{{'x': oa, 'y': ea, 't': o}}, {{'x': ea, 'y': oa, 't': e}}, {{'x': ob, 'y': eb, 't': o}}, {{'x': eb, 'y': ob, 't': e}}, {{'x': oc, 'y': ec, 't': o}}, {{'x': ec, 'y': oc, 't': e}}]]) AS chi FROM tt)"""


@query(f""", {SPLIT} SELECT oa AS a_only, ob AS b_only, oc AS "both", round(ec, 6) AS mean_both, round(chi, 4) AS chi2, round(exp(-chi / 2), 6) AS p FROM ch""")
def resplit_test(s, d):
    a, b = V.reg_a(s, d), V.reg_b(s, d)
    return peaks.resplit_test(a, b, 3, a.count()).withColumns({"mean_both": F.round("mean_both", 6), "chi2": F.round("chi2", 4), "p": F.round("p", 6)})


def activity(s, d):
    per = V.reads(s, d).groupBy("name")
    side = lambda o, c: F.sum(F.when(F.col("orientation") == o, F.col(c)).otherwise(0)).cast("double")
    return per.agg(side("+", "score").alias("ps_1"), side("-", "score").alias("ps_2"), side("+", "initial").alias("tc_1"), side("-", "initial").alias("tc_2"))


def _span(c: str) -> str:
    return f"({c}_2 - {c}_1) / (greatest(max({c}_1) OVER (), max({c}_2) OVER ()) - least(min({c}_1) OVER (), min({c}_2) OVER ()))"


@query(f""", q AS (SELECT name, """ + ", ".join(f"sum(CASE WHEN orientation = '{o}' THEN {c} ELSE 0 END)::DOUBLE AS {n}" for o, c, n in (("+", "score", "ps_1"), ("-", "score", "ps_2"), ("+", "initial", "tc_1"), ("-", "initial", "tc_2"))) + f""" FROM reads GROUP BY name), r AS (SELECT name, {_span('ps')} + {_span('tc')} AS activity FROM q)
SELECT name, round(activity, 5) + 0.0 AS activity, round((activity - avg(activity) OVER ()) / stddev_pop(activity) OVER (), 4) + 0.0 AS z FROM r""")
def activity_changes(s, d):
    return peaks.activity_change(activity(s, d), "name").select("name", (F.round("activity", 5) + 0.0).alias("activity"), (F.round("z", 4) + 0.0).alias("z"))
