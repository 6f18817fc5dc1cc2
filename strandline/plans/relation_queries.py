"""Queries of relations between interval sets, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association, joins, project, relations as R
from . import views as V
from .catalog import COLS, OV, isl, query

HITS = "tpx AS (SELECT *, (_ord % 1000003 * 7919) % 1000003 AS rna_i, (_ord % 1000003 * 7919) % 1000003 + 3 + score % 4 AS rna_f FROM reads)"


def hits(s, d):
    """Triplex hits: reads as DNA places, with a place on the RNA."""
    at = (F.col("_ord") % 1000003 * 7919) % 1000003
    return V.reads(s, d).withColumns({"rna_i": at, "rna_f": at + 3 + F.col("score") % 4})


@query("SELECT a._ord, coalesce(nullif(n.new, ''), a.name) AS name FROM reg_a a LEFT JOIN (SELECT 'p' || n_nationkey AS old, n_name AS new FROM nation) n ON a.name = n.old")
def change_names(s, d):
    names = V._read(s, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("old"), F.col("n_name").alias("new"))
    return V.reg_a(s, d).join(names, F.col("name") == F.col("old"), "left").select("_ord", F.coalesce(F.nullif("new", F.lit("")), "name").alias("name"))


@query(f"SELECT g._ord, h.o AS orientation FROM genes g LEFT JOIN (SELECT a._ord, arg_min(b.orientation, (b.initial, b.final, b._ord)) AS o FROM genes a JOIN reg_b b ON {OV} GROUP BY a._ord) h USING (_ord)")
def strand_from_overlap(s, d):
    return R.first_overlapping(V.genes(s, d).drop("orientation"), V.reg_b(s, d), "orientation", "orientation").select("_ord", "orientation")


@query(f"SELECT g._ord, coalesce(h.o, '.') AS name FROM reg_a g LEFT JOIN (SELECT a._ord, arg_min(b.name, (b.initial, b.final, b._ord)) AS o FROM reg_a a JOIN reg_b b ON {OV} GROUP BY a._ord) h USING (_ord)")
def map_names(s, d):
    return R.first_overlapping(V.reg_a(s, d).drop("name"), V.reg_b(s, d), "name", "name").select("_ord", "name").fillna(".", ["name"])


@query(f"SELECT chrom, max(n) > 1 AS overlaps, sum(n - 1)::BIGINT AS n_inside FROM {isl('reg_a')} GROUP BY chrom")
def self_overlaps(s, d):
    return R.self_overlap(V.reg_a(s, d))


@query("""SELECT a._ord, CASE WHEN a.chrom = b.chrom THEN greatest(b.initial - a.final, a.initial - b.final, 0) END AS distance,
  CASE WHEN a.chrom <> b.chrom THEN NULL WHEN a.final <= b.initial THEN -1 WHEN a.initial >= b.final THEN 1 ELSE 0 END AS code FROM reg_a a JOIN reg_b b ON a._ord // 10000000000 = b._ord""")
def pair_positions(s, d):
    b = V.reg_b(s, d).select(F.col("_ord").alias("o"), *(F.col(c).alias(f"b_{c}") for c in COLS))
    both = V.reg_a(s, d).join(b, F.floor(F.col("_ord") / (10 * V.LINE)) == F.col("o"))
    same, place = F.col("chrom") == F.col("b_chrom"), [F.col(c) for c in ("initial", "final", "b_initial", "b_final")]
    return both.select("_ord", F.when(same, R.gap(*place)).alias("distance"), F.when(same, R.position_code(*place)).alias("code"))


@query("""SELECT _ord, b_ord, distance FROM (SELECT *, row_number() OVER (PARTITION BY _ord, side ORDER BY abs(distance), bi, bf, b_ord) AS r FROM (
  SELECT a._ord, b._ord AS b_ord, b.initial AS bi, b.final AS bf, CASE WHEN b.final <= a.initial THEN -1 WHEN b.initial >= a.final THEN 1 ELSE 0 END AS side,
    CASE WHEN b.final <= a.initial THEN b.final - a.initial WHEN b.initial >= a.final THEN b.initial - a.final ELSE 0 END AS distance
  FROM genes a JOIN reg_b b ON a.chrom = b.chrom AND greatest(a.initial - 5000, 0) < b.final AND b.initial < a.final + 5000) WHERE abs(distance) < 5000) WHERE side = 0 OR r = 1""")
def signed_distances(s, d):
    return association.distances(V.genes(s, d), V.reg_b(s, d), 5000)


REST = f"""cut AS (SELECT a._ord, a.chrom, a.initial AS ai, a.final AS af, greatest(a.initial, b.initial) AS x, least(a.final, b.final) AS y FROM genes a JOIN {isl('reg_a')} b ON {OV}),
rest AS (SELECT * FROM (SELECT _ord, chrom, coalesce(lag(y) OVER (PARTITION BY _ord ORDER BY x), ai) AS initial, x AS final FROM cut UNION ALL SELECT _ord, chrom, max(y), af FROM cut GROUP BY _ord, chrom, af
  UNION ALL SELECT _ord, chrom, initial, final FROM genes WHERE _ord NOT IN (SELECT _ord FROM cut)) WHERE initial < final)"""


@query(f", {REST} SELECT * FROM rest")
def subtract_unmerged(s, d):
    return R.remnants(V.genes(s, d), V.reg_a(s, d))


@query(f", {REST} SELECT r._ord, r.chrom, r.initial, r.final FROM rest r JOIN genes g USING (_ord) QUALIFY row_number() OVER (PARTITION BY r._ord ORDER BY CASE WHEN g.orientation = '+' THEN r.initial ELSE -r.initial END) = 1")
def cut_upstream(s, d):
    return R.cut_keep_end(V.genes(s, d), V.reg_a(s, d))


@query("SELECT name, chrom, min(initial) AS initial, max(final) AS final FROM (SELECT *, first_value(chrom) OVER (PARTITION BY name ORDER BY _ord) AS c FROM reg_a) WHERE chrom = c GROUP BY name, chrom")
def merge_by_name_first_chrom(s, d):
    a = V.reg_a(s, d)
    first = a.groupBy("name").agg(F.min_by("chrom", "_ord").alias("chrom"))
    return a.join(first, ["name", "chrom"]).groupBy("name", "chrom").agg(F.min("initial").alias("initial"), F.max("final").alias("final"))


RUNS = """, runs AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY initial, final, _ord ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(orientation) OVER (PARTITION BY chrom ORDER BY initial, final, _ord) = orientation THEN 0 ELSE 1 END AS nw FROM reg_b))"""


@query(f"{RUNS} SELECT chrom, orientation, initial, final, n FROM {isl('runs', 0, 'chrom, orientation, run')}".replace("SELECT *, CASE WHEN pm", "SELECT * EXCLUDE (nw), CASE WHEN pm"))
def merge_adjacent_strand(s, d):
    return R.merge_adjacent(V.reg_b(s, d), "orientation")


@query(f"SELECT a.orientation AS a_set, b.name AS b_set, count(DISTINCT a._ord) AS n FROM reg_a a JOIN reg_b b ON {OV} GROUP BY ALL")
def overlap_matrix(s, d):
    """How many rows of each set of a overlap each set of b, for all pairs of sets at once."""
    met = joins.overlap_join(V.reg_a(s, d).select("_ord", *COLS, "orientation"), V.reg_b(s, d).select(*COLS, "name"))
    return met.select("_ord", F.col("orientation").alias("a_set"), F.col("b_name").alias("b_set")).distinct().groupBy("a_set", "b_set").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT _ord, CASE WHEN EXISTS (SELECT 1 FROM (SELECT chrom, greatest((initial + final) // 2 - 100, 0) AS initial, (initial + final) // 2 + 100 AS final FROM reg_b) b WHERE {OV}) THEN 'Y' ELSE 'N' END AS hit FROM reg_a a")
def evidence(s, d):
    return R.overlap_flag(V.reg_a(s, d), project.relocate(V.reg_b(s, d), "midpoint", 100, 100)).select("_ord", "hit")


@query(f"SELECT a._ord, string_agg(b.name, ',' ORDER BY b.name) AS names FROM reg_b a JOIN genes b ON {OV} AND a.orientation <> b.orientation GROUP BY a._ord")
def opposite_strand_names(s, d):
    return R.overlapping_names(V.reg_b(s, d), V.genes(s, d), same_strand=False)


@query(f"SELECT _ord FROM reg_b a WHERE EXISTS (SELECT 1 FROM (SELECT chrom, CASE WHEN orientation = '+' THEN greatest(initial - 1000, 0) ELSE initial END AS initial, CASE WHEN orientation = '+' THEN final ELSE final + 1000 END AS final FROM genes WHERE score > 25) b WHERE {OV})")
def filter_by_association(s, d):
    return joins.semi(V.reg_b(s, d), project.extend_stream(V.genes(s, d).filter("score > 25"), 1000)).select("_ord")


TSS = "(SELECT _ord, chrom, CASE WHEN orientation = '{}' THEN initial ELSE final - 1 END AS initial, CASE WHEN orientation = '{}' THEN initial + 1 ELSE final END AS final FROM genes)"


@query(f"SELECT chrom, initial, final, n FROM {isl(TSS.format('+', '+'))}")
def tss_sites(s, d):
    return R.tss(V.genes(s, d))


@query(f"SELECT chrom, initial, final, n FROM {isl(TSS.format('-', '-'))}")
def tts_sites(s, d):
    return R.tss(V.genes(s, d), end=True)


@query("""SELECT mask, count(*) AS n FROM (SELECT k, sum(DISTINCT b)::BIGINT AS mask FROM (SELECT l_partkey AS k, 1 AS b FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 2 FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_partkey, 4 FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40) GROUP BY k) GROUP BY mask""")
def venn_partitions(s, d):
    li = V._read(s, d, "lineitem")
    return R.partitions([li.filter(w) for w in ("l_returnflag = 'R'", "l_returnflag = 'A'", "l_returnflag = 'N' AND l_quantity > 40")], "l_partkey")


@query(", u AS (SELECT _ord, chrom, initial, final FROM reg_b UNION ALL SELECT _ord, chrom, initial, final FROM genes)" + f" SELECT _ord FROM reg_a a WHERE EXISTS (SELECT 1 FROM {isl('u')} b WHERE {OV})")
def trim_to_union(s, d):
    return joins.semi(V.reg_a(s, d), V.reg_b(s, d).select(*COLS).unionByName(V.genes(s, d).select(*COLS))).select("_ord")


@query("SELECT name, arg_max(score, (_ord, score)) AS score FROM reg_a GROUP BY name")
def upsert_latest(s, d):
    return V.reg_a(s, d).groupBy("name").agg(F.max_by("score", F.struct("_ord", "score")).alias("score"))


@query("SELECT p_brand AS key, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS mapped FROM part GROUP BY p_brand")
def attribute_mappings(s, d):
    return V._read(s, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("mapped"))


@query("SELECT _ord FROM reg_a ORDER BY md5(_ord || ':1'), _ord LIMIT 500")
def random_subregions(s, d):
    return V.reg_a(s, d).orderBy(F.md5(F.concat(F.col("_ord").cast("string"), F.lit(":1")).cast("binary")), "_ord").limit(500).select("_ord")


@query("SELECT chrom, rank() OVER (ORDER BY substr(chrom, 4)::BIGINT) AS place FROM chroms")
def natural_order(s, d):
    """Labels by their trailing number; chr2 before chr10."""
    from pyspark.sql import Window

    return V.sizes(s, d).select("chrom", F.rank().over(Window.orderBy(F.regexp_extract("chrom", r"(\d+)$", 1).cast("bigint"))).cast("bigint").alias("place"))  # a row for each chromosome


@query("""SELECT transcript, chrom, initial, final FROM (SELECT _ord // 10000000000 AS transcript, min(initial) AS initial, max(final) AS final FROM reads GROUP BY 1)
JOIN (SELECT l_orderkey AS transcript, 'chr' || (1 + min(l_suppkey::BIGINT) % 22) AS chrom FROM lineitem GROUP BY l_orderkey) USING (transcript)""")
def transcripts_from_exons(s, d):
    e = V.reads(s, d).withColumn("transcript", F.floor(F.col("_ord") / (10 * V.LINE)))
    li = V._read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("transcript")).agg(F.concat(F.lit("chr"), (1 + F.min("l_suppkey") % 22).cast("string")).alias("chrom"))
    return e.groupBy("transcript").agg(F.min("initial").alias("initial"), F.max("final").alias("final")).join(li, "transcript")


RNA = isl("r").replace("count(*) AS n", "count(*) AS n, count(DISTINCT dna) AS n_places")


@query(f", {HITS}, r AS (SELECT 'rna' AS chrom, rna_i AS initial, rna_f AS final, _ord, chrom || ':' || initial || '-' || final AS dna FROM tpx) SELECT initial AS rna_i, final AS rna_f, n, n_places FROM {RNA}")
def triplex_domains(s, d):
    return R.merge_rna_sites(hits(s, d))


@query(f", {HITS} SELECT position, count(*) AS n FROM (SELECT unnest(range(rna_i, rna_f)) AS position FROM tpx) GROUP BY position")
def triplex_rna_track(s, d):
    return hits(s, d).select(F.explode(F.sequence(F.col("rna_i"), F.col("rna_f") - 1)).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("n"))


@query(f", {HITS} SELECT CASE WHEN chrom <> 'chr3' THEN 'trans' WHEN greatest(400000 - final, initial - 402000, 0) > 10000 THEN 'cis' ELSE 'local' END AS kind, count(*) AS n FROM tpx GROUP BY kind")
def triplex_distances(s, d):
    kind = R.cis_class(F.col("chrom"), F.col("initial"), F.col("final"), ("chr3", 400000, 402000))
    return hits(s, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


WINDOWS = "SELECT _ord, chrom, greatest(e - 300, 0) AS initial, e AS final FROM (SELECT _ord, chrom, CASE WHEN orientation = '+' THEN initial - 500 ELSE final + 800 END AS e FROM genes) WHERE e > 0"


@query(WINDOWS)
def upstream_windows(s, d):
    return project.stream_window(V.genes(s, d), 500, 300).select("_ord", *COLS)


@query("""SELECT DISTINCT pair FROM (SELECT pair, chrom, min(initial) AS i, max(final) AS f FROM (SELECT *, _ord // 20000000000 AS pair FROM reads) GROUP BY pair, chrom HAVING count(*) = 2 AND count(DISTINCT orientation) = 2) p
JOIN (SELECT chrom, greatest(initial - 20000, 0) AS initial, final + 20000 AS final FROM genes) r USING (chrom) WHERE i > r.initial AND f < r.final""")
def proper_pairs_inside(s, d):
    reads = V.reads(s, d).withColumn("pair", F.floor(F.col("_ord") / (20 * V.LINE)))
    return R.pairs_inside(reads, project.extend(V.genes(s, d), 20000, 20000), "pair")
