"""Queries of signals, sequences and tests; with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import motif
from ..functions import sequence as seq
from ..operators import joins, placement
from ..operators import signal as S
from ..operators import significance as T
from ..operators import stats
from . import views as V
from .catalog import COLS, OV, isl, query


def bins(df):
    return df.groupBy("chrom", F.floor(F.col("initial") / 1000).alias("bin")).agg(F.count(F.lit(1)).alias("value"))


BINS = "x AS (SELECT chrom, initial // 1000 AS bin, count(*) AS value FROM reg_a GROUP BY ALL), y AS (SELECT chrom, initial // 1000 AS bin, count(*) AS value FROM reg_b GROUP BY ALL)"


@query(f", {BINS} SELECT chrom, bin, coalesce(x.value, 0) + coalesce(y.value, 0) AS value FROM x FULL JOIN y USING (chrom, bin)")
def add_coverage(s, d):
    return S.combine_bins(bins(V.reg_a(s, d)), bins(V.reg_b(s, d)))


@query(f", {BINS} SELECT chrom, bin, greatest(coalesce(x.value, 0) - coalesce(y.value, 0), 0) AS value FROM x FULL JOIN y USING (chrom, bin)")
def subtract_coverage(s, d):
    return S.combine_bins(bins(V.reg_a(s, d)), bins(V.reg_b(s, d)), subtract=True)


@query(f", {BINS} SELECT chrom, bin, round(value / ((SELECT sum(value) FROM x) / 1e6), 6) AS value FROM x")
def reads_per_million(s, d):
    return S.per_million(bins(V.reg_a(s, d))).withColumn("value", F.round("value", 6))


@query("""SELECT doc_id, round(v * (avg(v) OVER ()) / (avg(v) OVER (PARTITION BY gc)), 4) AS value FROM (
  SELECT doc_id, length(seq)::DOUBLE AS v, trunc(100 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(length(seq), 0))::INT AS gc FROM dna WHERE length(seq) > 0)""")
def gc_norm(s, d):
    x = V.dna(s, d).filter(F.length("seq") > 0).select("doc_id", F.length("seq").cast("double").alias("value"), (100 * seq.gc_content(F.col("seq"))).cast("int").alias("gc"))
    return S.stratum_norm(x, "value", "gc").select("doc_id", F.round("value", 4).alias("value"))


TRUTH = f"t AS (SELECT score, EXISTS (SELECT 1 FROM genes b WHERE {OV}) AS hit FROM reg_b a)"
ROC = f""", {TRUTH}, e AS (SELECT score, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM t GROUP BY score),
c AS (SELECT score, p, n, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM e WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _curve(s, d):
    from ..operators.relations import overlap_flag

    return S.curve(overlap_flag(V.reg_b(s, d), V.genes(s, d)), "score", F.col("hit") == "Y", 1000)


@query(f"{ROC} SELECT score, tp, fp, round(tp / tot_p, 6) AS tpr, round(fp / tot_n, 6) AS fpr FROM c")
def roc_curve(s, d):
    return _curve(s, d).select("score", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"{ROC} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / tot_p, 6) AS recall FROM c")
def precision_recall(s, d):
    return _curve(s, d).select("score", F.round("precision", 6).alias("precision"), F.round("tpr", 6).alias("recall"))


@query(f"{ROC} SELECT round(sum(n * (tp - p / 2)) / max(tot_p * tot_n), 6) AS auc FROM c")
def roc_auc(s, d):
    return S.auc(_curve(s, d)).select(F.round("auc", 6).alias("auc"))


@query(f"SELECT _ord, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT r._ord, count(b.chrom) AS n FROM genes r LEFT JOIN reads b ON r.chrom = b.chrom AND r.initial < b.final AND b.initial < r.final GROUP BY r._ord)")
def heatmap_order(s, d):
    """Regions ranked by their number of reads; ranks are made on the distinct numbers."""
    per = stats.counts_per_region(V.genes(s, d), V.reads(s, d)).select("_ord", "n")
    each = per.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    place = S.running(each, "n", ["c"], 256).select("n", (F.col("c_c") - F.col("c") + 1).alias("place"))
    return per.join(place, "n").select("_ord", "n", "place")


X = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def arrays(s, d):
    return V._read(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def flat(df, name="y"):
    """(vec_id, i, y): array entries by position, rounded after all sums."""
    return df.select("vec_id", F.posexplode(name).alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round("v", 5) + 0.0).alias("y"))


FLAT = "SELECT vec_id, (generate_subscripts(y, 1) - 1)::BIGINT AS i, round(unnest(y), 5) + 0.0 AS y FROM"


@query(f"{FLAT} (SELECT vec_id, [list_avg(x[greatest(i - 2, 1):i + 2]) for i in range(1, len(x) + 1)] AS y FROM {X})")
def smooth_signal(s, d):
    return flat(arrays(s, d).select("vec_id", S.moving_mean(F.col("x"), 2).alias("y")))


@query(f"{FLAT} (SELECT vec_id, [v / list_avg([u for u in x if u > 0]) for v in x] AS y FROM {X})")
def positive_mean(s, d):
    return flat(arrays(s, d).select("vec_id", S.positive_mean_norm(F.col("x")).alias("y")))


@query(f"{FLAT} (SELECT vec_id, [CASE WHEN v = 0 THEN 0.0 ELSE 1 / (1 + exp(-(v - 0.1) / 0.5)) END for v in x] AS y FROM {X})")
def logistic_norm(s, d):
    return flat(arrays(s, d).select("vec_id", S.squash(F.col("x"), F.lit(0.1), F.lit(0.5)).alias("y")))


@query(f"{FLAT} (SELECT vec_id, [(4 * (x[i + 8] - x[i]) + 3 * (x[i + 7] - x[i + 1]) + 2 * (x[i + 6] - x[i + 2]) + x[i + 5] - x[i + 3]) / 60 for i in range(1, len(x) - 7)] AS y FROM {X})")
def signal_slope(s, d):
    return flat(arrays(s, d).select("vec_id", S.convolve(F.col("x"), S.slope_weights(9, 2)).alias("y")))


@query(f"SELECT vec_id, round((list_sum(x) - list_sum(x[(len(x) - 10) // 2 + 1:(len(x) - 10) // 2 + 10])) / (len(x) - 10) - list_sum(x[(len(x) - 10) // 2 + 1:(len(x) - 10) // 2 + 10]) / 10, 5) + 0.0 AS score, round(list_sum(x), 5) + 0.0 AS tags FROM {X}")
def protection_scores(s, d):
    score, tags = S.protection(F.col("x"), 10)
    return arrays(s, d).select("vec_id", (F.round(score, 5) + 0.0).alias("score"), (F.round(tags, 5) + 0.0).alias("tags"))


@query(f"SELECT label, i, round(avg(v), 5) + 0.0 AS y FROM (SELECT label, (generate_subscripts(x, 1) - 1)::BIGINT AS i, unnest(x) AS v FROM {X}) GROUP BY ALL")
def average_profile(s, d):
    return arrays(s, d).select("label", F.posexplode("x").alias("i", "v")).groupBy("label", F.col("i").cast("bigint").alias("i")).agg((F.round(F.avg("v"), 5) + 0.0).alias("y"))


@query("""SELECT orientation, round(exp(quantile_cont(l - m, 0.5)), 6) AS factor FROM (SELECT orientation, ln(n) AS l, avg(ln(n)) OVER (PARTITION BY name) AS m FROM (
  SELECT name, orientation, count(*) AS n FROM reads GROUP BY ALL)) GROUP BY orientation""")
def size_factors(s, d):
    n = V.reads(s, d).groupBy("name", "orientation").agg(F.count(F.lit(1)).alias("n"))
    return S.size_factors(n, "name", "orientation", "n").select("orientation", F.round("factor", 6).alias("factor"))


@query("""SELECT shift, count(*) AS n FROM (SELECT DISTINCT chrom, final AS e FROM reads WHERE orientation = '-') r, range(0, 300, 5) t(shift)
  JOIN (SELECT DISTINCT chrom, initial AS at FROM reads WHERE orientation = '+') f ON f.chrom = r.chrom AND f.at = r.e - shift GROUP BY shift""")
def strand_cross_correlation(s, d):
    return S.strand_shift(V.reads(s, d), range(0, 300, 5))


BASES = "ACGT"


@query("SELECT doc_id, length(seq)::BIGINT AS total, " + ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS n_{b.lower()}" for b in BASES) + ", " + ", ".join(f"((length(seq) - length(replace(seq, '{w}', ''))) // 2)::BIGINT AS n_{w.lower()}" for w in ("CG", "GC", "AA")) + " FROM dna")
def base_statistics(s, d):
    count = lambda w: ((F.length("seq") - F.length(F.replace("seq", F.lit(w)))) / len(w)).cast("bigint").alias(f"n_{w.lower()}")
    return V.dna(s, d).select("doc_id", F.length("seq").cast("bigint").alias("total"), *map(count, (*BASES, "CG", "GC", "AA")))


@query("SELECT position, base, count(*) AS n FROM (SELECT unnest(range(1, length(seq) + 1)) AS position, unnest(string_split(seq, '')) AS base FROM dna WHERE seq <> '') GROUP BY ALL")
def position_frequencies(s, d):
    at = F.posexplode(F.split("seq", "")).alias("i", "base")
    return V.dna(s, d).select(at).filter("base <> ''").groupBy((F.col("i") + 1).cast("bigint").alias("position"), "base").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, round(ln(nullif(sum(score) FILTER (orientation = '+'), 0) / nullif(sum(score) FILTER (orientation = '-'), 0)), 6) AS ratio FROM reads GROUP BY name")
def log_ratios(s, d):
    side = lambda o: F.nullif(F.sum(F.when(F.col("orientation") == o, F.col("score"))), F.lit(0))
    return V.reads(s, d).groupBy("name").agg(F.round(F.log(side("+") / side("-")), 6).alias("ratio"))


#: Two made-up count matrices: rows A, C, G, T.
COUNTS = {"box": [[1, 17, 1, 16, 15, 2], [2, 1, 1, 1, 2, 9], [1, 1, 1, 2, 1, 7], [16, 1, 17, 1, 2, 2]], "site": [[2, 1, 14, 1, 3, 1], [15, 1, 2, 1, 14, 2], [1, 2, 3, 17, 1, 15], [2, 16, 1, 1, 2, 2]]}
CUT = 6.5


def matrices():
    return {name: motif.log_odds(c) for name, c in COUNTS.items()}


def _score_sql(w) -> str:
    return " + ".join(f"[{', '.join(f'{float(v)!r}::DOUBLE' for v in w[:, j])}][instr('ACGT', substr(kmer, {j + 1}, 1))]" for j in range(w.shape[1]))


@query("""SELECT doc_id, motif, strand, start, round(score, 6) AS score FROM (SELECT doc_id, unnest(range(0, length(seq) - 5)) AS start, unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM dna WHERE length(seq) >= 6)
JOIN (""" + " UNION ALL ".join(f"SELECT kmer, '{n}' AS motif, '{o}' AS strand, {_score_sql(m)} AS score FROM (SELECT a || b || c || d || e || f AS kmer FROM {', '.join(f'(SELECT unnest([{chr(39)}A{chr(39)}, {chr(39)}C{chr(39)}, {chr(39)}G{chr(39)}, {chr(39)}T{chr(39)}]) AS {x})' for x in 'abcdef')})" for n, w in matrices().items() for o, m in (("+", w), ("-", w[::-1, ::-1]))) + f") USING (kmer) WHERE score >= {CUT}")  # fmt: skip
def motif_scan(s, d):
    return motif.scan(V.dna(s, d), "doc_id", matrices(), CUT).withColumn("score", F.round("score", 6))


SCAN = ("SELECT doc_id, motif, strand, start, score FROM (SELECT doc_id, unnest(range(0, length(seq) - 5)) AS start, unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM dna WHERE length(seq) >= 6) JOIN ("
        + " UNION ALL ".join(f"SELECT kmer, '{n}' AS motif, '{o}' AS strand, {_score_sql(m)} AS score FROM (SELECT a || b || c || d || e || f AS kmer FROM {', '.join(f'(SELECT unnest([{chr(39)}A{chr(39)}, {chr(39)}C{chr(39)}, {chr(39)}G{chr(39)}, {chr(39)}T{chr(39)}]) AS {x})' for x in 'abcdef')})" for n, w in matrices().items() for o, m in (("+", w), ("-", w[::-1, ::-1])))
        + f") USING (kmer) WHERE score >= {CUT}")


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Right tail of Fisher's exact test by logarithms of factorials, as SQL."""
    lf = lambda x: f"lgamma({x} + 1.0)"
    fixed = f"({lf(f'({a}+{b})')} + {lf(f'({c}+{d})')} + {lf(f'({a}+{c})')} + {lf(f'({b}+{d})')} - {lf(f'({a}+{b}+{c}+{d})')})"
    term = f"exp({fixed} - {lf('k')} - {lf(f'({a}+{b}-k)')} - {lf(f'({a}+{c}-k)')} - {lf(f'({d}-{a}+k)')})"
    return f"least(1.0, list_sum([{term} for k in range({a}, least({a}+{b}, {a}+{c}) + 1)]))"


@query(f""", l AS (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents), hit AS (SELECT DISTINCT doc_id, motif FROM ({SCAN})), t AS (SELECT lang, motif, count(*) AS docs, count(hit.doc_id) AS a FROM (SELECT l.*, unnest({list(COUNTS)}) AS motif FROM l) LEFT JOIN hit USING (doc_id, motif) GROUP BY ALL),
u AS (SELECT motif, lang, a, docs - a AS b, (sum(a) OVER w - a)::BIGINT AS c, (sum(docs) OVER w - docs - sum(a) OVER w + a)::BIGINT AS d FROM t WINDOW w AS (PARTITION BY motif)), p AS (SELECT *, {fisher_sql('a', 'b', 'c', 'd')} AS p FROM u),
r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY round(p, 9)) AS raw FROM p) SELECT motif, lang, a, b, c, d, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY round(p, 9) DESC)), 6) AS q FROM r""")
def motif_enrichment(s, d):
    """For each motif and language: documents with a site against those of all other languages, right-tail Fisher, corrected."""
    docs = V._read(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    found = motif.scan(V.dna(s, d), "doc_id", matrices(), CUT).select("doc_id", "motif").distinct()
    total = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    names = F.explode(F.array(*map(F.lit, COUNTS))).alias("motif")
    per = total.select("*", names).join(found.join(docs, "doc_id").groupBy("motif", "lang").agg(F.count(F.lit(1)).alias("a")), ["motif", "lang"], "left").fillna(0, ["a"])
    every = Window.partitionBy("motif")  # one row for each language
    table = per.select("motif", "lang", "a", (F.col("docs") - F.col("a")).alias("b"), (F.sum("a").over(every) - F.col("a")).alias("c"), (F.sum("docs").over(every) - F.col("docs")).alias("others")).withColumn("d", F.col("others") - F.col("c")).drop("others")
    tested = stats.benjamini_hochberg(table.withColumn("p", F.round(T.fisher("a", "b", "c", "d"), 9)), "p")
    return tested.withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


@query(f"SELECT doc_id, motif, strand, start, round(normalised, 4) AS normalised FROM (SELECT *, " + "CASE motif " + " ".join(f"WHEN '{n}' THEN (score - {motif.bounds(w)[0]!r}) / {motif.bounds(w)[1] - motif.bounds(w)[0]!r} * 1000" for n, w in matrices().items()) + f" END AS normalised FROM ({SCAN}))")
def normalised_motif_scores(s, d):
    hits = motif.scan(V.dna(s, d), "doc_id", matrices(), CUT)
    return motif.with_normalised(hits, matrices()).select("doc_id", "motif", "strand", "start", F.round("normalised", 4).alias("normalised"))


@query(f"SELECT doc_id, motif, start, round(max(score), 6) AS score, CASE WHEN count(*) = 1 THEN any_value(strand) ELSE arg_max(strand, (score, CASE WHEN strand = '+' THEN 1 ELSE 0 END)) END AS strand FROM ({SCAN}) GROUP BY doc_id, motif, start")
def best_strand_hits(s, d):
    hits = motif.scan(V.dna(s, d), "doc_id", matrices(), CUT)
    return motif.best_strand(hits, "doc_id").withColumn("score", F.round("score", 6))


COUNTED = f"""(SELECT (SELECT count(*) FROM (SELECT chrom, (initial + final) // 2 AS m FROM reg_b) q WHERE EXISTS (SELECT 1 FROM {isl('reg_a')} r WHERE r.chrom = q.chrom AND q.m > r.initial AND q.m < r.final)) AS k,
(SELECT count(*) FROM reg_b) AS n, (SELECT sum(final - initial) FROM {isl('reg_a')}) / (22 * 1200000) AS p)"""
PMF = "exp(lgamma(n + 1.0) - lgamma({x} + 1.0) - lgamma(n - {x} + 1.0) + {x} * ln(p) + (n - {x}) * ln(1 - p))"


@query(f"SELECT k, n, round(p, 9) AS p, round(least(1.0, list_sum(list_filter([{PMF.format(x='x')} for x in range(0, n + 1)], lambda v: v <= top))), 5) AS p_value FROM (SELECT *, {PMF.format(x='k')} * (1 + 1e-7) AS top FROM {COUNTED})")
def projection_test(s, d):
    out = T.projection_test(V.reg_a(s, d), V.reg_b(s, d), 22 * 1200000)
    return out.withColumns({"p": F.round("p", 9), "p_value": F.round("p_value", 5)})


@query(f"""SELECT (SELECT count(*) FROM (SELECT chrom, (initial + final) // 2 AS m FROM reg_b) q WHERE EXISTS (SELECT 1 FROM {isl('reg_a')} r WHERE r.chrom = q.chrom AND q.m > r.initial AND q.m < r.final)) AS k,
(SELECT count(*) FROM reg_b) AS n, round((SELECT sum(final - initial) FROM {isl('reg_a')}) / (22 * 1200000), 9) AS p""")
def projection_counts(s, d):
    return T.projection_test(V.reg_a(s, d), V.reg_b(s, d), 22 * 1200000).select("k", "n", F.round("p", 9).alias("p"))


PLACED = f"""st AS (SELECT rep, _ord, chrom, final - initial AS size, ('0x' || substr(md5(rep || ':' || _ord || ':1'), 1, 12))::BIGINT % greatest(1200000 - (final - initial), 1) AS at_ FROM reg_a, range(1, 11) r(rep)),
pl AS (SELECT _ord, rep || ':' || chrom AS chrom, at_ AS initial, at_ + size AS final FROM st UNION ALL SELECT _ord, '0:' || chrom, initial, final FROM reg_a), mp AS {isl('pl')}, mb AS {isl('reg_b')},
j AS (SELECT rep, coalesce(cm, 0) / (a + (SELECT sum(final - initial) FROM mb) - coalesce(cm, 0)) AS j FROM (SELECT split_part(chrom, ':', 1) AS rep, sum(final - initial) AS a FROM mp GROUP BY 1)
  LEFT JOIN (SELECT split_part(a.chrom, ':', 1) AS rep, sum(least(a.final, b.final) - greatest(a.initial, b.initial)) AS cm FROM mp a JOIN mb b ON split_part(a.chrom, ':', 2) = b.chrom AND a.initial < b.final AND b.initial < a.final GROUP BY 1) USING (rep))"""


@query(f", {PLACED} SELECT any_value(o.j) AS observed, count(*) AS repeats, count(*) FILTER (j.j > o.j) AS n_larger, count(*) FILTER (j.j > o.j) / 10 AS p_value FROM j, (SELECT j FROM j WHERE rep = '0') o WHERE rep <> '0'")
def jaccard_test(s, d):
    return T.jaccard_test(V.reg_a(s, d), V.reg_b(s, d), 10, 1200000)


@query("""SELECT chrom, min(i) AS initial, max(i) + 1000 AS final, count(*) AS n, sum(value)::BIGINT AS value FROM (
  SELECT *, i - 1000 * row_number() OVER (PARTITION BY chrom ORDER BY i) AS g FROM (SELECT chrom, initial // 1000 * 1000 AS i, count(*) AS value FROM reg_b GROUP BY ALL)) GROUP BY chrom, g""")
def consecutive_bins(s, d):
    b = bins(V.reg_b(s, d)).select("chrom", (F.col("bin") * 1000).alias("initial"), (F.col("bin") * 1000 + 1000).alias("final"), "value")
    return S.merge_bins(b, ("chrom",), "value")


@query(f"""SELECT g._ord, round(coalesce(m, 0), 6) AS mean FROM genes g LEFT JOIN (SELECT a._ord, sum(b.score * (least(a.final, b.final) - greatest(a.initial, b.initial))) / sum(least(a.final, b.final) - greatest(a.initial, b.initial)) AS m
FROM genes a JOIN reg_b b ON {OV} GROUP BY a._ord) USING (_ord)""")
def mean_signal(s, d):
    return S.mean_signal(V.genes(s, d), V.reg_b(s, d).withColumn("value", F.col("score"))).select("_ord", F.round("mean", 6).alias("mean"))


@query(f", {BINS}, s AS (SELECT 'x' AS sample, * FROM x UNION ALL SELECT 'y', * FROM y) SELECT chrom, bin, round(sum(value / m), 6) AS score FROM s JOIN (SELECT sample, avg(value) AS m FROM s GROUP BY sample) USING (sample) GROUP BY chrom, bin HAVING sum(value / m) > 2.5")
def putative_bins(s, d):
    rows = bins(V.reg_a(s, d)).withColumn("sample", F.lit("x")).unionByName(bins(V.reg_b(s, d)).withColumn("sample", F.lit("y")))
    return S.putative_bins(rows, ("chrom", "bin"), "sample", "value", 2.5).withColumn("score", F.round("score", 6))


@query(f""", {BINS}, two AS (SELECT coalesce(x.value, 0) AS a, coalesce(y.value, 0) AS b FROM x FULL JOIN y USING (chrom, bin)), per AS (SELECT a AS cut, sum(a) AS x, sum(b) AS y FROM two GROUP BY a),
c AS (SELECT cut, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(x) OVER () AS tx, sum(y) OVER () AS ty FROM per WINDOW w AS (ORDER BY cut)) SELECT cut, round(x / y, 6) AS factor FROM c ORDER BY y / ty - x / tx DESC, cut LIMIT 1""")
def control_factor(s, d):
    two = bins(V.reg_a(s, d)).withColumnRenamed("value", "a").join(bins(V.reg_b(s, d)).withColumnRenamed("value", "b"), ["chrom", "bin"], "full").fillna(0, ["a", "b"])
    return S.extraction_factor(two, "a", "b").withColumn("factor", F.round("factor", 6))


PLACES = f""", gaps AS (SELECT chrom, initial, final, sum(final - initial) OVER (ORDER BY chrom, initial) - (final - initial) AS off, sum(final - initial) OVER () AS total FROM (SELECT chrom, i AS initial, f AS final FROM (
  SELECT chrom, 0 AS i, min(initial) AS f FROM {isl('genes')} GROUP BY chrom UNION ALL SELECT chrom, final, coalesce(lead(initial) OVER (PARTITION BY chrom ORDER BY initial), 1200000) FROM {isl('genes')}
  UNION ALL SELECT chrom, 0, 1200000 FROM chroms WHERE chrom NOT IN (SELECT chrom FROM genes)) WHERE i < f)),
drawn AS (SELECT rep, _ord, k, final - initial AS size, ('0x' || substr(md5(rep || ':' || _ord || ':' || k || ':1'), 1, 12))::BIGINT % (SELECT any_value(total) FROM gaps)::BIGINT AS at_ FROM reg_b, range(1, 3) r(rep), range(1, 21) t(k)),
fits AS (SELECT rep, _ord, k, size, chrom, (initial + at_ - off)::BIGINT AS initial FROM drawn ASOF JOIN gaps ON at_ >= off WHERE initial + at_ - off + size <= final)"""


@query(f"{PLACES} SELECT rep, _ord, arg_min(chrom, k) AS chrom, arg_min(initial, k) AS initial, arg_min(initial + size, k) AS final FROM (SELECT rep, a._ord, k, chrom, f.initial, size FROM (SELECT rep, _ord FROM reg_b, range(1, 3) r(rep)) a LEFT JOIN fits f USING (rep, _ord)) GROUP BY rep, _ord")
def random_places(s, d):
    return placement.place(V.reg_b(s, d), V.sizes(s, d), V.genes(s, d), 2)


@query(f""", bg AS (SELECT _ord, chrom, greatest(initial - 5000, 0) AS initial, final + 5000 AS final FROM genes), own AS (SELECT * FROM bg a WHERE EXISTS (SELECT 1 FROM reg_b b WHERE {OV})),
wide AS (SELECT _ord, chrom, greatest(initial - 200, 0) AS initial, final + 200 AS final FROM reg_b), m AS {isl('wide')},
cut AS (SELECT a._ord, a.chrom, a.initial AS ai, a.final AS af, greatest(a.initial, b.initial) AS x, least(a.final, b.final) AS y FROM own a JOIN m b ON {OV}),
free AS (SELECT * FROM (SELECT _ord, chrom, coalesce(lag(y) OVER (PARTITION BY _ord ORDER BY x), ai) AS initial, x AS final FROM cut UNION ALL SELECT _ord, chrom, max(y), af FROM cut GROUP BY _ord, chrom, af) WHERE initial < final),
h AS (SELECT *, final - initial AS n, ('0x' || substr(md5(_ord || ':' || initial || ':1'), 1, 12))::BIGINT AS rank, ('0x' || substr(md5(_ord || ':start:1'), 1, 12))::BIGINT AS st FROM free),
p AS (SELECT _ord, chrom, arg_min(initial + st % nullif(n - 100, 0), (rank, initial)) FILTER (n > 100) AS s, arg_max((initial + final) // 2 - 50, (n, -initial)) AS mid FROM h GROUP BY _ord, chrom)
SELECT _ord, chrom, coalesce(s, mid) AS initial, coalesce(s, mid) + 100 AS final, s IS NOT NULL AS fits FROM p""")
def close_windows(s, d):
    """One window of 100 positions near each gene's orders, at least 200 from each."""
    near = V.genes(s, d).select("_ord", "chrom", F.greatest(F.col("initial") - 5000, F.lit(0)).alias("initial"), (F.col("final") + 5000).alias("final"))
    return placement.close_windows(V.reg_b(s, d), near)


@query()
def random_places_apart(s, d):
    """Rounds of draws; tests hold them against a version that goes row by row."""
    return placement.place_apart(V.genes(s, d), V.sizes(s, d), V.reg_b(s, d))


@query(f""", c AS (SELECT g._ord, count(b._ord) FILTER (b.name LIKE '1%') AS x, count(b._ord) FILTER (b.name LIKE '2%') AS y, count(b._ord) FILTER (b.orientation = '-') AS z FROM genes g LEFT JOIN reg_b b ON g.chrom = b.chrom AND g.initial < b.final AND b.initial < g.final GROUP BY g._ord),
f AS (SELECT x + 1 AS x, y + 1 AS y, z + 1 AS z, (x + y + z + 3) / 3 AS m FROM c) SELECT * FROM (SELECT 'x' AS sample, round(avg(m / x), 6) AS factor FROM f UNION ALL SELECT 'y', round(avg(m / y), 6) FROM f UNION ALL SELECT 'z', round(avg(m / z), 6) FROM f)""")
def gene_level_factors(s, d):
    met = joins.overlap_join(V.genes(s, d).select("_ord", *COLS), V.reg_b(s, d).select(*COLS, "name", "orientation"))
    n = met.groupBy("_ord").agg(F.count_if(F.col("b_name").startswith("1")).alias("x"), F.count_if(F.col("b_name").startswith("2")).alias("y"), F.count_if(F.col("b_orientation") == "-").alias("z"))
    return S.gene_factors(V.genes(s, d).select("_ord").join(n, "_ord", "left"), ["x", "y", "z"]).withColumn("factor", F.round("factor", 6))


@query("SELECT orientation, count(*) AS n, count(DISTINCT name) AS names, round(avg(final - initial), 6) AS mean_length FROM reg_a GROUP BY orientation")
def read_totals(s, d):
    size = F.col("final") - F.col("initial")
    return V.reg_a(s, d).groupBy("orientation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.round(F.avg(size), 6).alias("mean_length"))
