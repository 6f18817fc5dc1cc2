"""Work that grows with the rows, not with the pairs of rows: no step of a plan may make more rows than it needs."""

import math
import random
import time
from collections import Counter

import pytest

from strandline.operators import association, binned, cuts, joins, motifs, peaks, placement, relations, signal, stats, tools, triplex
from test_intervals import df


def most_rows(frame):
    """The most rows that any step of the plan made, once the frame is collected."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        found = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([found.get().value() if found.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    rows = frame.collect()
    return rows, walk(frame._jdf.queryExecution().executedPlan())


def names(spark, n):
    """n names of one gene family, and an alias table in which that name means n genes."""
    wanted = spark.createDataFrame([("Hot",)] * n + [("hOt",), ("none",), (None,)], "name string")
    aliases = spark.createDataFrame([("hot", i) for i in range(n)] + [("cold", n), ("lost", None)], "alias string, gene_id long")
    return wanted, aliases


def test_unmapped_names_make_no_pairs(spark):
    wanted, aliases = names(spark, 300)
    rows, most = most_rows(tools.unmapped(wanted, aliases))
    assert sorted((r.name for r in rows), key=str) == [None, "none"] and most < 2_000


def annotation(spark, n):
    return spark.createDataFrame([("exon", i % (n + 1), "x", "c1", i, i + 5, "+") for i in range(n + 1)], "feature string, gene_id long, name string, chrom string, initial long, final long, orientation string")


def test_exons_of_a_gene_set_make_no_pairs(spark):
    wanted, aliases = names(spark, 300)
    rows, most = most_rows(tools.annotated(annotation(spark, 300), "exon", wanted, aliases))
    assert sorted(r.gene_id for r in rows) == list(range(300)) and {r.name for r in rows} == {"Hot"} and most < 2_000


def test_promoters_of_a_gene_set_make_no_pairs(spark):
    wanted, aliases = names(spark, 300)
    rows, most = most_rows(tools.annotation_promoters(annotation(spark, 300), 10, 2, "exon", wanted, aliases))
    assert sorted((r.initial, r.final) for r in rows) == [(i - 10, i + 3) for i in range(300)] and most < 2_000


def random_rows(rng, n, span, most):
    return [(a, a + rng.randrange(most)) for a in (rng.randrange(-5, span) for _ in range(n))]


def overlaps(x, y):
    return x[0] < y[1] and y[0] < x[1]


def test_totals_equal_all_pairs(spark):
    """Rows over many bins, empty ones and equal ones among them."""
    rng = random.Random(4)
    a, b = random_rows(rng, 150, 300, 60) + [(50, 50)], random_rows(rng, 200, 300, 20) + [(50, 50), (49, 51), (3, 290)]
    own = df(spark, a)
    other = df(spark, b).withColumn("w", binned.F.col("_ord"))
    got = {r._ord: (r.n, r.w) for r in binned.totals(own, other, ("_ord",), {"n": None, "w": "w"}, width=16).collect()}
    want = {i: [j for j, y in enumerate(b) if overlaps(x, y)] for i, x in enumerate(a)}
    assert got == {i: (len(js), sum(js)) for i, js in want.items() if js}


def test_area_where_all_rows_are_true(spark):
    points = signal.curve(spark.createDataFrame([(1, "Y"), (2, "Y")], "score int, hit string"), "score", binned.F.col("hit") == "Y", 10)
    assert signal.auc(points).collect()[0].auc is None
    assert most_rows(joins.semi(df(spark, [(i, 500) for i in range(300)]), df(spark, [(i, 600) for i in range(300)])))[1] < 2_000


def crowd(spark, n=300):
    """n rows that all overlap one another, with all columns of a view."""
    return df(spark, [(i, 600 + i) for i in range(n)]).selectExpr("*", "'+' AS orientation", "_ord % 3 = 0 AS tail", "'n' || _ord % 7 AS name", "_ord AS score")


def test_counts_make_no_pairs(spark):
    rows, most = most_rows(stats.counts_per_region(crowd(spark), crowd(spark)))
    assert {(r.n, r.full_bp) for r in rows} == {(300, 300 * 600)} and most < 2_000


def test_profile_of_overlaps_makes_no_pairs(spark):
    rows, most = most_rows(tools.overlap_profile(crowd(spark), {"x": crowd(spark), "y": crowd(spark).filter("_ord < 0")}))
    assert [tuple(r) for r in rows] == [("x", 300)] and most < 2_000


def test_tails_make_no_pairs(spark):
    rows, most = most_rows(tools.tail_counts(crowd(spark), crowd(spark), 100, 50))
    assert {r._ord: (r.n, r.tails) for r in rows}[0] == (150 + 50 + 100, 100) and most < 2_000


def test_windows_near_crowded_regions_make_no_pairs(spark):
    rows, most = most_rows(placement.close_windows(crowd(spark), crowd(spark).filter("_ord % 2 = 0").withColumn("final", binned.F.col("final") + 2000)))
    assert len(rows) == 150 and all(r.initial >= 899 + 200 and r.fits for r in rows) and most < 2_000


def test_bias_of_a_long_sequence_takes_linear_time(spark):
    letters = "".join(random.Random(1).choices("ACGTN", k=400_000))
    cuts_ = spark.createDataFrame([("x", "+", 7), ("x", "-", 1)], "doc string, orientation string, position long")
    began = time.time()
    rows = cuts.kmer_bias(cuts_, spark.createDataFrame([("x", letters)], "doc string, seq string"), "doc", 6).collect()
    want = Counter(letters[i : i + 6] for i in range(len(letters) - 5))
    assert time.time() - began < 30 and {r.kmer: r.expected - 1 for r in rows} == {k: n for k, n in want.items() if "N" not in k}


def hits(spark, n=300):
    """n hits that all overlap on the DNA, on an RNA of 100 bases."""
    rng = random.Random(8)
    rows = [(i, "c1", 1000 + i, 1400 + i, r, r + 5, rng.choice("+-"), rng.choice("MRY"), rng.choice("PA")) for i, r in enumerate(rng.randrange(100) for _ in range(n))]
    return spark.createDataFrame(rows, "_ord long, chrom string, initial long, final long, rna_i long, rna_f long, orientation string, motif string, direction string")


def test_switches_of_crowded_hits_make_no_pairs(spark):
    rows, most = most_rows(triplex.switch_kinds(hits(spark)))
    every = sorted(hits(spark).collect(), key=lambda r: (r.rna_i, r.rna_f, r._ord))[:-2]
    near = [(a, b) for a in every for b in every if 0 < b.rna_i - a.rna_f < 20 and a.direction != b.direction and a.orientation == b.orientation and b.rna_i - a.rna_f > 400]
    assert len(rows) == 15 and sum(r.n for r in rows) == len(near) == 0 and most < 2_000


def test_hits_by_crowded_region_make_no_pairs(spark):
    rows, most = most_rows(triplex.by_region(hits(spark), crowd(spark, 700)))
    every = hits(spark).collect()
    for r in rows:
        met = [h for h in every if overlaps((h.initial, h.final), (r._ord, 600 + r._ord))]
        covered = set().union(*(range(max(h.initial, r._ord), min(h.final, 600 + r._ord)) for h in met))
        assert (r.n_hits, r.n_sites, r.covered) == (len(met), len({(h.rna_i, h.rna_f) for h in met}), len(covered))
    assert len(rows) == 700 and most < 4_000


def test_domains_of_crowded_hits_make_no_pairs(spark):
    rows, most = most_rows(triplex.domain_counts(hits(spark), crowd(spark).withColumn("final", binned.F.col("final") + 900)))
    assert {r.bound for r in rows} == {300} and most < 4_000


def test_domain_tests_of_crowded_hits_make_no_pairs(spark):
    regions = crowd(spark).withColumn("final", binned.F.col("final") + 900)
    rows, most = most_rows(triplex.domain_tests(hits(spark), regions.filter("_ord < 100"), regions.filter("_ord >= 100")))
    assert {(r.a, r.b, r.c, r.d) for r in rows} == {(100, 0, 200, 0)} and most < 4_000


def test_pairs_inside_crowded_regions_make_no_pairs(spark):
    reads = df(spark, [(700 + i // 2, 710 + i // 2) for i in range(600)]).selectExpr("*", "_ord DIV 2 AS pair", "CASE WHEN _ord % 2 = 0 THEN '+' ELSE '-' END AS orientation")
    regions = df(spark, [(600 + i, 900 + i) for i in range(300)])
    rows, most = most_rows(relations.pairs_inside(reads, regions, "pair"))
    assert sorted(r.pair for r in rows) == list(range(300)) and most < 4_000
    assert relations.pairs_inside(reads, df(spark, [(700, 720), (600, 710)]), "pair").collect() == [(i,) for i in ()] or sorted(r.pair for r in relations.pairs_inside(reads, df(spark, [(700, 720), (600, 710)]), "pair").collect()) == list(range(1, 10))


def test_enrichment_of_crowded_sites_makes_no_pairs(spark):
    sites = crowd(spark).withColumnRenamed("name", "motif")
    rows, most = most_rows(motifs.enrichment(crowd(spark), sites, crowd(spark, 50), sites))
    assert {(r.motif, r.a, r.c, r.genes) for r in rows} == {(f"n{k}", 300, 50, 7) for k in range(7)} and most < 2_000


def test_label_hits_equal_all_pairs(spark):
    """Labels of few and of many sites, rows longer than a bin, empty ones."""
    rng = random.Random(7)
    a, b = random_rows(rng, 150, 300, 40) + [(50, 50)], random_rows(rng, 120, 300, 20) + [(50, 50), (49, 51), (3, 290)]
    left = df(spark, a).withColumn("name", binned.F.expr("'g' || _ord % 11"))
    right = df(spark, b).withColumn("label", binned.F.expr("CASE WHEN _ord % 9 > 0 THEN 'n' || _ord % 17 END"))
    for width in (8, 64):
        got = {r.label: (r.regions_hit, r.genes) for r in binned.label_hits(left, right, "label", names=True, width=width).collect()}
        want = {}
        for i, x in enumerate(a):
            for label in {f"n{j % 17}" for j, y in enumerate(b) if j % 9 and overlaps(x, y)}:
                want.setdefault(label, []).append(i)
        assert got == {k: (len(v), len({i % 11 for i in v})) for k, v in want.items()}


def test_sliding_bins_of_crowded_regions_make_no_pairs(spark):
    regions, reads = df(spark, [(500 + i, 700 + i) for i in range(300)]), df(spark, [(550 + i % 50, 586 + i % 50) for i in range(900)])
    rows, most = most_rows(stats.sliding_counts(regions, reads, 36))
    want = Counter()
    for i in range(300):
        for s in (550 + j % 50 for j in range(900)):
            if s < 900 + i and s + 36 > 300 + i:
                want.update((i, k) for k in range(4) if s < 500 + i + 50 * k + 50 and s + 236 >= 500 + i + 50 * k - 50)
    assert {(r._ord, r.k): r.n for r in rows} == want and most < 4_000


def test_names_of_crowded_regions_make_no_pairs(spark):
    rows, most = most_rows(association.associate(crowd(spark), crowd(spark)))
    assert len(rows) == 300 and {r.names for r in rows} == {":".join(f"n{i % 7}" for i in range(300))} and most < 2_000


def test_names_equal_all_pairs(spark):
    """Rows longer than a bin, empty ones and rows without a name among them."""
    rng = random.Random(6)
    a, b = random_rows(rng, 120, 300, 40) + [(50, 50)], random_rows(rng, 120, 300, 20) + [(50, 50), (49, 51), (3, 290)]
    right = df(spark, b).withColumn("name", binned.F.expr("CASE WHEN _ord % 5 > 0 THEN 'n' || _ord % 13 END"))
    name = lambda j: f"n{j % 13}" if j % 5 else None
    for width in (8, 64):
        for by_name in (False, True):
            got = {r._ord: r.names for r in binned.gathered(df(spark, a), right, ":", by_name, width=width).collect()}
            for i, x in enumerate(a):
                met = [name(j) for _, j in sorted((y, j) for j, y in enumerate(b) if overlaps(x, y))]
                words = [w for w in met if w]
                assert got[i] == (":".join(sorted(words) if by_name else words) if met else None)
        first = {r._ord: r.out for r in binned.first_row(df(spark, a), right, "_ord", "out", width=width).collect()}
        assert first == {i: min(((*y, j) for j, y in enumerate(b) if overlaps(x, y)), default=(0, 0, None))[2] for i, x in enumerate(a)}


def test_cuts_meet_regions_once(spark):
    """A region and a place are one row where they meet: nothing is dealt out and grouped again after that."""
    piled = cuts.pileup(df(spark, [(i, i + 100) for i in range(200)]), df(spark, [(i, i + 1) for i in range(300)] * 3))
    assert {r.n for r in piled.collect()} == {3} and piled.count() == 200 * 100
    text = piled._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join") < text.index("Aggregate")


def test_sorted_names_of_crowded_regions_make_no_pairs(spark):
    rows, most = most_rows(binned.gathered(crowd(spark), crowd(spark), ":", by_name=True))
    assert {r.names for r in rows} == {":".join(sorted(f"n{i % 7}" for i in range(300)))} and most < 2_000


def test_first_name_of_crowded_regions_makes_no_pairs(spark):
    rows, most = most_rows(relations.first_overlapping(crowd(spark).drop("name"), crowd(spark), "name", "name"))
    assert {r.name for r in rows} == {"n0"} and len(rows) == 300 and most < 2_000


def test_names_of_one_strand_make_no_pairs(spark):
    other = crowd(spark).withColumn("orientation", binned.F.expr("CASE WHEN _ord % 2 = 0 THEN '+' ELSE '-' END"))
    rows, most = most_rows(association.associate(crowd(spark), other, same_strand=True, show=True))
    assert {r.names for r in rows} == {":".join(f"n{i % 7}" for i in range(0, 300, 2))} and most < 2_000


def test_first_strand_of_crowded_regions_makes_no_pairs(spark):
    rows, most = most_rows(relations.first_overlapping(crowd(spark).drop("orientation"), crowd(spark), "orientation", "orientation"))
    assert {r.orientation for r in rows} == {"+"} and len(rows) == 300 and most < 2_000


def test_permutations_of_crowded_regions_make_no_pairs(spark):
    rows, most = most_rows(triplex.permutation_tests(hits(spark), crowd(spark).withColumn("final", binned.F.col("initial") + 3000), 3, 3000))
    assert {(r.bound, r.mean, r.sd, r.p) for r in rows} == {(300, 300.0, 0.0, 1.0)} and most < 5_000


@pytest.mark.parametrize("stranded", [False, True])
def test_hulls_over_bins_equal_a_plain_pass(spark, stranded):
    rng = random.Random(9)

    def made(n):
        return [(i, "c1", s, s + rng.randrange(40, 700), rng.choice("+++-"), f"n{i}", rng.randrange(1, 90) / 10) for i, s in enumerate(rng.randrange(40_000) for _ in range(n))]

    a, b = made(500), [*made(300), (300, "c1", 8_100, 24_700, "+", "long", 3.0)]
    a.append((500, "c1", 8_150, 8_800, "+", "over", 2.0))
    frame = lambda rows: spark.createDataFrame(rows, "_ord long, chrom string, initial long, final long, orientation string, name string, p double")
    rule = lambda x, y: max(max(x, y) - math.log10(2), min(x, y))
    pairs = sorted((x[2], x[3], x[0], y[0], x[4], f"{x[5]}:{y[5]}", rule(x[6], y[6])) for x in a for y in b if overlaps(x[2:4], y[2:4]) and (not stranded or x[4] == y[4]))
    want, side, top = [], None, 0
    for i, f, _, _, o, name, p in pairs:
        if o != side:
            side, top = o, None
        if top is None or i >= top:
            want.append(["c1", o, i, f, name, p])
            top = f
        else:
            want[-1][3], want[-1][5] = max(want[-1][3], f), rule(want[-1][5], p)
        top = max(top, f)
    rows, most = most_rows(peaks.combined(frame(a), frame(b), stranded))
    got = sorted((r.chrom, r.orientation, r.initial, r.final, r.name, round(r.p, 9)) for r in rows)
    assert got == sorted((*w[:5], round(w[5], 9)) for w in want) and most < len(pairs)


def test_bins_of_one_side_alone(spark):
    """Rows a bin and more apart: every kernel sees bins without rows of the other side."""
    a = df(spark, [(10, 50), (400_000, 400_050)]).selectExpr("*", "'+' AS orientation", "'n' AS name", "1.0D AS p")
    b = df(spark, [(20, 60), (800_000, 800_010)]).selectExpr("*", "'+' AS orientation", "'m' AS name", "2.0D AS p", "_ord AS rna_i", "_ord + 5 AS rna_f")
    assert [(r._ord, r.n) for r in binned.totals(a, b, ("_ord",), {"n": None}).collect()] == [(0, 1)]
    assert {r._ord: r.out for r in binned.first_row(a, b, "name", "out").collect()} == {0: "m", 1: None}
    assert {r._ord: r.names for r in binned.gathered(a, b, ":").collect()} == {0: "m", 1: None}
    assert [(r.label, r.regions_hit, r.genes) for r in binned.label_hits(a, b, "name", names=True).collect()] == [("m", 1, 1)]
    assert [r._ord for r in binned.strictly_inside(df(spark, [(30, 40), (500_000, 500_001)]), b).collect()] == [0]
    assert {(r._ord, r.k) for r in stats.sliding_counts(df(spark, [(100, 150), (600_000, 600_050)]), b, 36).collect()} == {(0, 0)}
    assert {r._ord: (r.n_hits, r.covered) for r in triplex.by_region(b, a).collect()} == {0: (1, 30), 1: (0, 0)}
    assert [(r.initial, r.final, r.name) for r in peaks.combined(a, b).collect()] == [(10, 50, "n:m")]


def test_placement_rounds_are_one_shuffle(spark):
    """Rows that crowd each other out: sixty rounds end in time, and no two places overlap."""
    sizes = spark.createDataFrame([("c1", 30_000)], "chrom string, length long")
    began = time.time()
    rows = placement.place_apart(df(spark, [(0, 500 + i % 7) for i in range(300)]), sizes, df(spark, [(k * 5_000, k * 5_000 + 50) for k in range(6)]), rounds=20).collect()
    found = sorted((r.initial, r.final) for r in rows if r.initial is not None)
    assert len(rows) == 300 and len(found) > 25 and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False)) and time.time() - began < 60
