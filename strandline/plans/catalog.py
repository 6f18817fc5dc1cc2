"""Registry of the library's own queries, each with DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import association, binned, islands, joins, project, relations, stats
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def isl(rel: str, gap: int = 0, keys: str = "chrom") -> str:
    """Islands of a relation as SQL: the running maximum over a whole key, the plain form of what the operator scans in blocks. Rows that
    tie in all of the order share a number."""
    return f"""(SELECT {keys}, min(initial) AS initial, max(final) AS final, count(*) AS n FROM (
      SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY initial, final, _ord) AS g FROM (
        SELECT *, CASE WHEN pm IS NULL OR initial - {gap} >= pm THEN 1 ELSE 0 END AS nw FROM (
          SELECT *, max(final) OVER (PARTITION BY {keys} ORDER BY initial, final, _ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {rel})))
      GROUP BY {keys}, g)"""


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql begins after the common views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {V.CTE}\n{sql}"
        return f

    return add


OV = "a.chrom = b.chrom AND a.initial < b.final AND b.initial < a.final"
PER = f"""FROM reg_a r LEFT JOIN (SELECT a.chrom, a.initial, a.final, count(*) AS n, sum(b.final - b.initial) AS bp FROM (SELECT DISTINCT chrom, initial, final FROM reg_a) a JOIN reg_b b ON {OV} GROUP BY ALL) p USING (chrom, initial, final)"""
COLS = ("chrom", "initial", "final")


@query(f"SELECT chrom, initial, final, n FROM {isl('reads')}")
def merge_intervals(s, d):
    return islands.merge(V.reads(s, d))


@query(f"SELECT chrom, initial, final, n FROM {isl('reg_a', 200)}")
def cluster_intervals(s, d):
    return islands.merge(V.reg_a(s, d), 200)


@query(f"SELECT chrom, orientation, initial, final, n FROM {isl('reg_a', 0, 'chrom, orientation')}")
def merge_by_strand(s, d):
    return islands.merge(V.reg_a(s, d), 0, ("chrom", "orientation"))


@query("SELECT name, chrom, min(initial) AS initial, max(final) AS final, count(*) AS n FROM reg_a GROUP BY name, chrom")
def merge_by_name(s, d):
    return V.reg_a(s, d).groupBy("name", "chrom").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n"))


PIECES = f"(SELECT a.chrom, greatest(a.initial, b.initial) AS initial, least(a.final, b.final) AS final FROM {isl('reg_a')} a JOIN {isl('reg_b')} b ON {OV})"


@query(f"SELECT * FROM {PIECES}")
def intersect_overlap(s, d):
    return joins.intersect(V.reg_a(s, d), V.reg_b(s, d))


@query(f"SELECT _ord, chrom, initial, final FROM reg_a a WHERE EXISTS (SELECT 1 FROM reg_b b WHERE {OV})")
def intersect_original(s, d):
    return joins.semi(V.reg_a(s, d), V.reg_b(s, d)).select("_ord", *COLS)


@query(f"SELECT _ord, chrom, initial, final FROM reg_a a WHERE NOT EXISTS (SELECT 1 FROM reg_b b WHERE {OV})")
def exclude_overlapping(s, d):
    return joins.semi(V.reg_a(s, d), V.reg_b(s, d), anti=True).select("_ord", *COLS)


@query(f"SELECT a._ord, a.chrom, a.initial, a.final, b.initial AS b_initial, b.final AS b_final FROM reg_a a JOIN reg_b b ON {OV} AND a.initial >= b.initial AND a.final <= b.final")
def intersect_contained(s, d):
    return joins.contained(V.reg_a(s, d), V.reg_b(s, d)).select("_ord", *COLS, "b_initial", "b_final")


@query(f"""SELECT a._ord, b._ord AS b_ord FROM (SELECT _ord, chrom, greatest(initial - 1000, 0) AS initial, final + 1000 AS final FROM reg_a) a JOIN genes b ON {OV}""")
def window_join(s, d):
    return joins.overlap_join(project.extend(V.reg_a(s, d), 1000, 1000), V.genes(s, d)).select("_ord", F.col("b__ord").alias("b_ord"))


NEAR = """SELECT a._ord, a.chrom, a.initial, a.final, b.initial AS b_initial, b.final AS b_final, greatest(b.initial - a.final, a.initial - b.final, 0) AS distance
  FROM reg_b a JOIN genes b ON a.chrom = b.chrom AND greatest(a.initial - 10000, 0) < b.final AND b.initial < a.final + 10000
  QUALIFY row_number() OVER (PARTITION BY a._ord ORDER BY greatest(b.initial - a.final, a.initial - b.final, 0), b.initial, b.final) = 1"""


@query(NEAR)
def closest(s, d):
    return association.nearest(V.reg_b(s, d).select("_ord", *COLS), V.genes(s, d), 10000).drop("place")


DIFF = f"""SELECT chrom, i AS initial, f AS final FROM (
  SELECT chrom, coalesce(lag(y) OVER (PARTITION BY chrom, ai, af ORDER BY x), ai) AS i, x AS f FROM cut
  UNION ALL SELECT chrom, max(y), af FROM cut GROUP BY chrom, ai, af
  UNION ALL SELECT chrom, initial, final FROM m WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.chrom = m.chrom AND cut.ai = m.initial)) WHERE i < f"""


def diff(a: str, b: str) -> str:
    return f""", m AS (SELECT chrom, initial, final FROM {a}), r AS (SELECT chrom, initial, final FROM {isl(b)}),
cut AS (SELECT a.chrom, a.initial AS ai, a.final AS af, greatest(a.initial, b.initial) AS x, least(a.final, b.final) AS y FROM m a JOIN r b ON {OV})
{DIFF}"""


@query(diff(isl("reg_a"), "reg_b"))
def subtract_intervals(s, d):
    return joins.subtract(V.reg_a(s, d), V.reg_b(s, d))


@query(diff("chroms", "reg_a"))
def complement_intervals(s, d):
    return joins.complement(V.reg_a(s, d), V.sizes(s, d))


@query(f"SELECT chrom, initial, final FROM {isl('reg_a')} a WHERE NOT EXISTS (SELECT 1 FROM reg_b b WHERE {OV})")
def subtract_whole(s, d):
    return joins.semi(islands.merge(V.reg_a(s, d)), V.reg_b(s, d), anti=True).select(*COLS)


@query("SELECT DISTINCT chrom, initial, final FROM reg_a a WHERE NOT EXISTS (SELECT 1 FROM reads b WHERE b.score > 25 AND a.chrom = b.chrom AND a.initial = b.initial AND a.final = b.final)")
def subtract_exact(s, d):
    return V.reg_a(s, d).join(V.reads(s, d).filter("score > 25"), list(COLS), "left_anti").select(*COLS).distinct()


@query("SELECT _ord, chrom, greatest(initial - 50, 0) AS initial, final + 30 AS final FROM reg_a")
def extend_intervals(s, d):
    return project.extend(V.reg_a(s, d), 50, 30).select("_ord", *COLS)


@query("SELECT _ord, chrom, greatest(least(initial + 40, final - 40), 0) AS initial, greatest(initial + 40, final - 40) AS final FROM reg_a")
def shrink_intervals(s, d):
    return project.extend(V.reg_a(s, d), -40, -40).select("_ord", *COLS)


@query("SELECT _ord, chrom, CASE WHEN orientation = '+' THEN greatest(initial - 1000, 0) ELSE initial END AS initial, CASE WHEN orientation = '+' THEN final ELSE final + 1000 END AS final FROM reg_a")
def extend_upstream(s, d):
    return project.extend_stream(V.reg_a(s, d), 1000).select("_ord", *COLS)


@query("SELECT _ord, chrom, CASE WHEN orientation = '+' THEN initial ELSE greatest(initial - 1000, 0) END AS initial, CASE WHEN orientation = '+' THEN final + 1000 ELSE final END AS final FROM reg_a")
def extend_downstream(s, d):
    a = V.reg_a(s, d)
    return project.flip_strand(project.extend_stream(project.flip_strand(a), 1000)).select("_ord", *COLS)


@query("""SELECT _ord, chrom, greatest(initial - 500, 0) AS initial, initial AS final, 'upstream' AS side FROM genes
UNION ALL SELECT _ord, chrom, final, final + 500, 'downstream' FROM genes""")
def flank_intervals(s, d):
    return project.flank(V.genes(s, d), 500).select("_ord", *COLS, "side")


@query("SELECT _ord, chrom, greatest((initial + final) // 2 - 2000, 0) AS initial, (initial + final) // 2 + 2000 AS final FROM reg_a")
def relocate_intervals(s, d):
    return project.relocate(V.reg_a(s, d)).select("_ord", *COLS)


@query("""SELECT _ord, chrom, initial + k * 50 AS initial, initial + (k + 1) * 50 AS final FROM reg_a, range(0, 10) t(k) WHERE k < (final - initial) // 50
UNION ALL SELECT _ord, chrom, initial, final FROM reg_a WHERE final - initial < 50""")
def fragmentize_intervals(s, d):
    return project.fragmentize(V.reg_a(s, d), 50).select("_ord", *COLS)


@query("SELECT _ord, chrom, CASE WHEN orientation = '+' THEN greatest(initial - 1000, 0) ELSE final END AS initial, CASE WHEN orientation = '+' THEN initial ELSE final + 1000 END AS final FROM genes")
def gene_promoters(s, d):
    return project.promoters(V.genes(s, d)).select("_ord", *COLS)


@query("SELECT _ord, translate(orientation, '+-', '-+') AS orientation FROM reg_a")
def flip_strands(s, d):
    return project.flip_strand(V.reg_a(s, d)).select("_ord", "orientation")


@query("SELECT _ord, coalesce(nullif(name, 'p7'), chrom || ':' || initial || '-' || final) AS label FROM reg_a")
def interval_labels(s, d):
    a = V.reg_a(s, d).withColumn("name", F.nullif("name", F.lit("p7")))
    return a.select("_ord", project.label(a).alias("label"))


@query("SELECT _ord, least(greatest(score * 3 - 20, 0), 100) AS score FROM reg_a")
def clamp_scores(s, d):
    return V.reg_a(s, d).select("_ord", F.least(F.greatest(F.col("score") * 3 - 20, F.lit(0)), F.lit(100)).cast("bigint").alias("score"))


@query("SELECT _ord, chrom, initial, final FROM reg_a WHERE final - initial > 50 AND final - initial < 150")
def filter_by_size(s, d):
    n = F.col("final") - F.col("initial")
    return V.reg_a(s, d).filter((n > 50) & (n < 150)).select("_ord", *COLS)


@query("SELECT _ord, chrom, initial, final FROM reg_a WHERE orientation = '-'")
def filter_strand(s, d):
    return V.reg_a(s, d).filter("orientation = '-'").select("_ord", *COLS)


@query("SELECT _ord, name FROM reg_a WHERE upper(name) IN (SELECT DISTINCT upper('p' || (p_partkey % 9)) FROM part)")
def filter_by_names(s, d):
    wanted = V._read(s, d, "part").select(F.upper(F.concat(F.lit("p"), (F.col("p_partkey") % 9).cast("string"))).alias("w")).distinct()
    return V.reg_a(s, d).join(wanted, F.upper("name") == F.col("w"), "left_semi").select("_ord", "name")


@query("SELECT name, score FROM (SELECT 'p' || (p_partkey % 50) AS name, max(p_size)::BIGINT AS score FROM part GROUP BY 1) ORDER BY score DESC, name LIMIT 20")
def top_scores(s, d):
    p = V._read(s, d, "part").groupBy(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("name")).agg(F.max("p_size").cast("bigint").alias("score"))
    return p.orderBy(F.desc("score"), "name").limit(20)


@query("SELECT chrom, sum(final - initial)::BIGINT AS bp, count(*) AS n FROM reg_a GROUP BY chrom")
def total_coverage(s, d):
    return V.reg_a(s, d).groupBy("chrom").agg(F.sum(F.col("final") - F.col("initial")).alias("bp"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT *, round(both_bp / (a_bp + b_bp - both_bp), 6) AS jaccard FROM (SELECT sum(final - initial)::BIGINT AS a_bp FROM {isl('reg_a')}),
(SELECT sum(final - initial)::BIGINT AS b_bp FROM {isl('reg_b')}), (SELECT sum(final - initial)::BIGINT AS both_bp FROM {PIECES})""")
def jaccard(s, d):
    return stats.jaccard(V.reg_a(s, d), V.reg_b(s, d))


@query(f"""SELECT (SELECT count(*) FROM {isl('reg_a')} a WHERE NOT EXISTS (SELECT 1 FROM reg_b b WHERE {OV})) AS a_only,
(SELECT count(*) FROM {isl('reg_b')} a WHERE NOT EXISTS (SELECT 1 FROM reg_a b WHERE {OV})) AS b_only, (SELECT count(*) FROM {PIECES}) AS both""")
def intersect_count(s, d):
    return stats.intersect_count(V.reg_a(s, d), V.reg_b(s, d))


@query(f"SELECT r._ord, coalesce(n, 0) AS n {PER}")
def counts_per_region(s, d):
    return stats.counts_per_region(V.reg_a(s, d), V.reg_b(s, d)).select("_ord", "n")


@query(f"SELECT r._ord, round(coalesce(bp, 0) / (r.final - r.initial), 6) AS ratio {PER}")
def coverage_per_region(s, d):
    return stats.counts_per_region(V.reg_a(s, d), V.reg_b(s, d)).select("_ord", F.round(F.col("full_bp") / (F.col("final") - F.col("initial")), 6).alias("ratio"))


@query("SELECT chrom, count(*) AS n, round(avg(final - initial), 6) AS mean, min(final - initial) AS low, max(final - initial) AS high, round(stddev_pop(final - initial), 6) AS sd, median(final - initial) AS median FROM reg_a GROUP BY chrom")
def size_statistics(s, d):
    return stats.size_stats(V.reg_a(s, d))


@query("SELECT _ord, chrom, initial, final FROM genes QUALIFY rank() OVER (PARTITION BY chrom ORDER BY final - initial DESC) = 1")
def longest_regions(s, d):
    g = V.genes(s, d)
    top = g.groupBy("chrom").agg(F.max(F.col("final") - F.col("initial")).alias("top"))
    return g.join(top, "chrom").filter("final - initial = top").select("_ord", *COLS)


@query(f"SELECT chrom, round(sum(final - initial) / (SELECT sum(final - initial) FROM {isl('reg_a')}), 6) AS share FROM {isl('reg_a')} GROUP BY chrom")
def chromosome_distribution(s, d):
    per = islands.merge(V.reg_a(s, d)).groupBy("chrom").agg(F.sum(F.col("final") - F.col("initial")).alias("bp"))
    return per.select("chrom", F.round(F.col("bp") / F.sum("bp").over(Window.partitionBy()), 6).alias("share"))  # a row for each chromosome


@query("SELECT _ord, chrom, initial, final FROM reg_a UNION ALL SELECT _ord, chrom, initial, final FROM reg_b")
def combine_sets(s, d):
    return V.reg_a(s, d).select("_ord", *COLS).unionByName(V.reg_b(s, d).select("_ord", *COLS))


@query("SELECT chrom, initial, final, orientation, min(_ord) AS _ord FROM reads GROUP BY ALL")
def remove_duplicates(s, d):
    return V.reads(s, d).groupBy(*COLS, "orientation").agg(F.min("_ord").alias("_ord"))


@query("SELECT chrom, initial // 1000 AS bin, count(*) AS n FROM reads GROUP BY ALL")
def read_bins(s, d):
    return V.reads(s, d).groupBy("chrom", F.floor(F.col("initial") / 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r._ord, k, count(*) AS n FROM (SELECT * FROM genes) r JOIN reads q ON r.chrom = q.chrom AND q.initial < r.final + 200 AND r.initial - 200 < q.final, range(0, 40) t(k)
WHERE k < (r.final - r.initial) // 50 AND q.initial < r.initial + k * 50 + 50 AND q.initial + 236 >= greatest(r.initial + k * 50 - 50, 0) AND q.initial < r.final + 200 AND q.final > greatest(r.initial - 200, 0) GROUP BY ALL""")
def sliding_coverage(s, d):
    """Reads, extended by 200, in sliding bins (step 50, width 100) of each gene; bins without reads are left out."""
    return stats.sliding_counts(V.genes(s, d), V.reads(s, d), 36)


@query("""SELECT chrom, initial, final, depth FROM (SELECT chrom, pos AS initial, lead(pos) OVER w AS final, (sum(d) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM (
  SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, initial AS pos, 1 AS d FROM reg_a UNION ALL SELECT chrom, final, -1 FROM reg_a) GROUP BY chrom, pos) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE depth > 0""")
def depth_segments(s, d):
    return stats.depth(V.reg_a(s, d))


@query("""SELECT _ord, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 6) AS q FROM (
  SELECT _ord, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM (SELECT _ord, ((_ord % 100003 * 7919) % 100003) / 100003.0::DOUBLE AS p FROM reg_a))""")
def bh_correction(s, d):
    p = V.reg_a(s, d).select("_ord", (((F.col("_ord") % 100003 * 7919) % 100003) / F.lit(100003.0)).alias("p"))
    return stats.benjamini_hochberg(p, "p").select("_ord", F.round("q", 6).alias("q"))


@query(f"""SELECT r._ord, coalesce(string_agg(g.name, ':' ORDER BY g.name), '.') AS genes FROM reg_b r LEFT JOIN
(SELECT chrom, name, CASE WHEN orientation = '+' THEN greatest(initial - 1000, 0) ELSE initial END AS initial, CASE WHEN orientation = '+' THEN final ELSE final + 1000 END AS final FROM genes) g
ON r.chrom = g.chrom AND r.initial < g.final AND g.initial < r.final GROUP BY r._ord""")
def gene_association(s, d):
    return binned.gathered(V.reg_b(s, d), project.extend_stream(V.genes(s, d), 1000), ":", by_name=True).select("_ord", F.coalesce("names", F.lit(".")).alias("genes"))


@query("SELECT doc_id, round(CASE WHEN length(seq) > 0 THEN (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) END, 6) AS gc FROM dna")
def gc_content(s, d):
    return V.dna(s, d).select("doc_id", F.round(seq.gc_content(F.col("seq")), 6).alias("gc"))


@query("SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, translate(seq, 'T', 'U') AS rna FROM dna")
def sequence_maps(s, d):
    return V.dna(s, d).select("doc_id", seq.reverse_complement(F.col("seq")).alias("rc"), seq.to_rna(F.col("seq")).alias("rna"))


@query("SELECT kmer, count(*) AS n FROM (SELECT unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM dna WHERE length(seq) >= 6) WHERE length(kmer) = 6 GROUP BY kmer")
def kmer_counts(s, d):
    return seq.kmer_counts(V.dna(s, d), 6)


@query("""SELECT chrom, mask, count(*) AS segments, sum(final - initial)::BIGINT AS bp FROM (
  SELECT chrom, pos AS initial, lead(pos) OVER w AS final, (sum(a) OVER r > 0)::BIGINT + 2 * (sum(b) OVER r > 0)::BIGINT + 4 * (sum(g) OVER r > 0)::BIGINT AS mask FROM (
    SELECT chrom, pos, sum(a) AS a, sum(b) AS b, sum(g) AS g FROM (
      SELECT chrom, initial AS pos, 1 AS a, 0 AS b, 0 AS g FROM reg_a UNION ALL SELECT chrom, final, -1, 0, 0 FROM reg_a
      UNION ALL SELECT chrom, initial, 0, 1, 0 FROM reg_b UNION ALL SELECT chrom, final, 0, -1, 0 FROM reg_b
      UNION ALL SELECT chrom, initial, 0, 0, 1 FROM genes UNION ALL SELECT chrom, final, 0, 0, -1 FROM genes) GROUP BY chrom, pos)
  WINDOW w AS (PARTITION BY chrom ORDER BY pos), r AS (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE mask > 0 AND final IS NOT NULL GROUP BY chrom, mask""")
def combinatorial(s, d):
    """Covered positions for every combination of three sets, by one sweep with a bit for each set, scanned in blocks."""
    parts = []
    for i, v in enumerate((V.reg_a, V.reg_b, V.genes)):
        x = v(s, d)
        for at, sign in (("initial", 1), ("final", -1)):
            parts.append(x.select("chrom", F.col(at).alias("at"), *(F.lit(sign if j == i else 0).alias(f"d{j}") for j in range(3))))
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    steps = events.groupBy("chrom", "at").agg(*(F.sum(f"d{j}").alias(f"d{j}") for j in range(3))).withColumn("_block", F.floor(F.col("at") / islands.BLOCK))
    order = Window.partitionBy("chrom").orderBy("_block")
    per = steps.groupBy("chrom", "_block").agg(F.min("at").alias("first"), *(F.sum(f"d{j}").alias(f"s{j}") for j in range(3)))
    per = per.select("chrom", "_block", F.lead("first").over(order).alias("next_block"), *(F.coalesce(F.sum(f"s{j}").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{j}") for j in range(3)))
    inside = Window.partitionBy("chrom", "_block").orderBy("at")
    bits = [F.when(F.col(f"b{j}") + F.sum(f"d{j}").over(inside) > 0, 1 << j).otherwise(0) for j in range(3)]
    out = steps.join(per, ["chrom", "_block"]).select("chrom", F.col("at").alias("initial"), F.coalesce(F.lead("at").over(inside), F.col("next_block")).alias("final"), (bits[0] + bits[1] + bits[2]).cast("bigint").alias("mask"))
    return out.filter("mask > 0 AND final IS NOT NULL").groupBy("chrom", "mask").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("final") - F.col("initial")).alias("bp"))


@query("SELECT name, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT name, count(*) AS n FROM reg_a GROUP BY name)")
def rank_names(s, d):
    return V.reg_a(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("bigint"))  # one row for each name


@query("""SELECT user_id, min(ts_s) AS initial, max(ts_s) AS final, any_value(event_type) AS state, count(*) AS n FROM (
  SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts_s, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS ts_s, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) = event_type THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, g""")
def state_runs(s, d):
    """Run-length coding of a state path: consecutive events of one kind for each user."""
    e = V._read(s, d, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts_s"))
    rows = e.select(F.col("user_id").alias("chrom"), F.col("ts_s").alias("initial"), F.col("ts_s").alias("final"), F.col("event_id").alias("_ord"), F.col("event_type").alias("state"))
    runs = relations.with_runs(rows, "state").groupBy("chrom", "_run").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.first("state").alias("state"), F.count(F.lit(1)).alias("n"))
    return runs.select(F.col("chrom").alias("user_id"), "initial", "final", "state", "n")
