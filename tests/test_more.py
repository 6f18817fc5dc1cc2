"""Nearest rows, placement, motif thresholds, result tables and hand-made edge cases of the newer operators."""

import itertools
import random

import numpy as np
import pytest

from strandline.functions import motif
from strandline.operators import association as A
from strandline.operators import cuts, hmm, islands, placement, stats, triplex
from strandline.sources import results
from test_intervals import df


def rows(rng, n, span, most):
    return [(a, a + rng.randrange(1, most)) for a in (rng.randrange(span) for _ in range(n))]


@pytest.mark.parametrize("span", [900, 400_000])
def test_nearest_equals_brute_force_over_blocks(spark, span):
    rng = random.Random(span)
    a, b = rows(rng, 60, span, 40), rows(rng, 80, span, 60)
    got = {}
    for r in A.nearest(df(spark, a), df(spark, b), span // 10, 3).collect():
        got.setdefault(r._ord, []).append((r.distance, r.b_initial, r.b_final))
    for i, (s, f) in enumerate(a):
        every = sorted((max(x - f, s - y, 0), x, y) for x, y in b)
        near = [v for v in every if v[0] < span // 10]
        # Rows that only touch count as beside, at distance 0; three on either side and all that overlap are candidates.
        assert sorted(got.get(i, []))[:1] == near[:1] and [v[0] for v in sorted(got.get(i, []))] == [v[0] for v in near[:3]]


def test_nearest_of_nothing(spark):
    a = df(spark, [(5, 9)])
    e = a.filter("false")
    assert A.nearest(a, e, 100).count() == 0 and A.nearest(e, a, 100).count() == 0 and A.sides(a, e).count() == 0


def test_merge_of_blocks_equals_a_plain_pass(spark):
    rng = random.Random(9)
    for gap in (0, 30):
        data = rows(rng, 400, 20_000, 300) + [(100, 15_000), (19_990, 50_000)]
        want, end = [], None
        for s, f in sorted(data):
            if end is None or s - gap >= end:
                want.append([s, f, 0])
                end = f
            end = max(end, f)
            want[-1][1], want[-1][2] = max(want[-1][1], f), want[-1][2] + 1
        got = islands.merge(df(spark, data), gap, block=512).collect()
        assert sorted((r.initial, r.final, r.n) for r in got) == [tuple(w) for w in want]


def test_corrections(spark):
    rng = random.Random(3)
    p = [rng.random() ** 5 for _ in range(300)] + [0.0, 1.0, 1e-300, 0.5, 0.5]
    data = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(999, None)], "_ord long, p double")
    for dependent in (False, True):
        n, factor = len(p), sum(1 / k for k in range(1, len(p) + 1)) if dependent else 1.0
        low, want = 1.0, {}
        for rank, i in sorted(((sum(y <= x for y in p), i) for i, x in enumerate(p)), reverse=True):
            low = min(low, p[i] * n * factor / rank)
            want[i] = low
        got = {r._ord: r for r in stats.corrected(data, "p", 0.1, dependent).collect()}
        assert got[999].q is None and all(got[i].q == pytest.approx(want[i], rel=1e-12) and got[i].rejected == (got[i].q <= 0.1) for i in want)


def test_threshold_of_a_false_positive_rate():
    w = motif.log_odds([[9, 0, 3, 1, 0], [0, 9, 3, 2, 0], [0, 0, 3, 8, 1], [0, 0, 0, 0, 9]])
    scores = np.array(sorted(sum(w[x, j] for j, x in enumerate(word)) for word in itertools.product(range(4), repeat=5)))
    for fpr in (0.001, 0.01, 0.1, 0.5):
        cut = motif.score_threshold(w, fpr)
        assert (scores >= cut + 0.003).mean() <= fpr and (scores >= cut - 0.05).mean() >= min(fpr, 1) * 0.5
    assert motif.score_threshold(w, 1e-9) > scores[-1] - 0.003
    assert motif.is_palindrome(motif.log_odds([[9, 0], [0, 0], [0, 0], [0, 9]])) and not motif.is_palindrome(w)


def test_places_fit_and_follow_free_positions(spark):
    sizes = spark.createDataFrame([("c1", 1000), ("c2", 9000)], "chrom string, length long")
    block = spark.createDataFrame([("c1", 100, 900), ("c2", 4000, 5000)], "chrom string, initial long, final long")
    one = df(spark, [(0, 50)] * 40 + [(0, 100_000)])
    got = placement.place(one, sizes, block, 20).collect()
    assert len(got) == 41 * 20 and all(r.chrom is None for r in got if r._ord == 40)
    fits = [r for r in got if r._ord < 40]
    assert all(r.final - r.initial == 50 for r in fits)
    assert all(r.final <= 100 or 900 <= r.initial and r.final <= 1000 if r.chrom == "c1" else r.final <= 4000 or 5000 <= r.initial and r.final <= 9000 for r in fits)
    assert 0.9 < sum(r.chrom == "c2" for r in fits) / len(fits) <= 1
    assert got and {(r.rep, r._ord, r.initial) for r in placement.place(one.repartition(5), sizes, block, 20).collect()} == {(r.rep, r._ord, r.initial) for r in got}


def test_signals_of_edge_arrays(spark):
    data = spark.createDataFrame([([],), ([0.0, 0.0],), ([1.0],), ([1.0, 5.0, 900.0, 2.0, 0.0, 3.0, 4.0],)], "x array<double>")
    for f in (lambda x: cuts.clipped(x, 10), lambda x: cuts.between_sets(x, 98), cuts.masked_mean):
        assert [len(r[0]) for r in data.select(f(data.x)).collect()] == [0, 2, 1, 7]
    top = data.select(cuts.percentile(data.x, 50)).collect()
    assert [r[0] for r in top] == [None, 0.0, 1.0, 3.0]
    got = data.select(cuts.masked_mean(data.x, 5, 2)).collect()[3][0]
    assert got == pytest.approx([1.0, 1.5, 1.0, 5 / 3, 9 / 4, 9 / 4, 7 / 3])


def test_kmer_bias_of_a_hand_made_sequence(spark):
    seqs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "AC"), (3, None)], "doc_id long, seq string")
    at = spark.createDataFrame([(1, "+", 2)] * 150 + [(1, "-", 0), (1, "-", 9), (2, "+", 1), (1, "-", 3)], "doc_id long, orientation string, position long")
    got = {(r.orientation, r.kmer): (r.observed, r.expected) for r in cuts.kmer_bias(at, seqs, "doc_id", 4).collect()}
    assert got["+", "ACGT"] == (101, 3) and got["-", "CGTA"] == (2, 3) and got["-", "ACGT"] == (1, 3) and ("+", "AAAA") not in got


def test_triplexes_of_nothing(spark):
    hit = spark.createDataFrame([(1, "c1", 5, 9, "+", 10, 20, "M", "AcG-")], "_ord long, chrom string, initial long, final long, orientation string, rna_i long, rna_f long, motif string, match string")
    none, region = hit.filter("false"), df(spark, [(0, 100), (500, 600)])
    assert triplex.switches(hit).count() == 0 and triplex.base_statistics(none).count() == 0
    assert sorted((r.base, r.n) for r in triplex.base_statistics(hit).collect()) == [("A", 1), ("G", 1)]
    assert [(r._ord, r.n_hits, r.covered) for r in sorted(triplex.by_region(hit, region).collect())] == [(0, 1, 4), (1, 0, 0)]
    assert triplex.domain_tests(none, region, region).count() == 0
    row = triplex.domain_tests(hit, region, region.filter("false")).first()
    assert (row.a, row.b, row.c, row.d, row.p) == (1, 1, 0, 0, 1.0)


def test_result_tables(spark, tmp_path):
    blocks = spark.createDataFrame([("c1", 100, 110, "t", "+"), ("c1", 105, 120, "t", "+"), ("c1", 200, 230, "t", "+"), ("c2", 1, 2, "u", "-")], "chrom string, initial long, final long, name string, orientation string")
    results.write_bed12(blocks.withColumn("_ord", islands.F.lit(1)), str(tmp_path / "b"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "b")).collect()) == ["c1\t100\t230\tt\t0\t+\t100\t230\t0\t2\t20,30\t0,100", "c2\t1\t2\tu\t0\t-\t1\t2\t0\t1\t1\t0"]
    results.write_genes(spark.createDataFrame([("A", 1.5), ("B", None)], "gene string, value double"), str(tmp_path / "g"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "g")).collect()) == ["A\t1.5", "B"]
    bias = spark.createDataFrame([("+", "AC", 0.5), ("-", "AC", 2.0)], "orientation string, kmer string, bias double")
    results.write_bias_table(bias, str(tmp_path / "t"))
    assert sorted(map(tuple, results.read_bias_table(spark, str(tmp_path / "t/F"), str(tmp_path / "t/R")).collect())) == [("+", "AC", 0.5), ("-", "AC", 2.0)]
    for name, p in (("x", "0.01"), ("y", "0.5")):
        (tmp_path / "e" / name).mkdir(parents=True)
        (tmp_path / "e" / name / "stat.txt").write_text("h\th\tp\n" + "\t".join(["M1", "", p, *[""] * 6, "g1,g2"]) + "\n" + ("M2\t\t0.2" + "\t" * 7 + "g3\n" if name == "x" else ""))
    rows_ = results.read_enrichment(spark, str(tmp_path / "e/*/stat.txt"), 0.1)
    assert {(r.condition, r.motif, r.p): r.genes for r in rows_.collect()} == {("x", "M1", 0.01): ["g1", "g2"], ("y", "M1", 0.5): None, ("x", "M2", 0.2): None}
    assert sorted(map(tuple, results.enrichment_matrix(rows_, ["x", "y"], 0.3).collect())) == [("M1", 0.01, 0.5), ("M2", 0.2, 1.0)]
    edges = results.network_edges(rows_, spark.createDataFrame([("M1", "T")], "motif string, gene string"), spark.createDataFrame([("G1",)], "gene string"))
    assert sorted(map(tuple, edges.collect())) == [("x", "T", "g1", True), ("y", "T", "g1", False)]


def test_models_as_text():
    model = hmm.Model(np.array([0.25, 0.75]), np.array([[0.5, 0.5], [0.125, 0.875]]), ((np.array([1.0, -2.0]), np.eye(2)), (np.array([0.5, 3.0]), np.array([[2.0, 0.5], [0.5, 1.0]]))), hmm.gaussian)
    back = results.read_model(results.model_lines(model))
    assert np.array_equal(back.start, model.start) and np.array_equal(back.trans, model.trans)
    assert all(np.array_equal(x, y) for p, q in zip(back.params, model.params, strict=True) for x, y in zip(p, q, strict=True))
