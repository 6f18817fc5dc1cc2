"""Sites in regions against a scan of whole strings, and enrichment at its edges."""

import random

import numpy as np
import pytest

from strandline.functions import motif
from strandline.operators import motifs, tools

WEIGHTS = {"a": motif.log_odds([[9, 1, 1, 5], [1, 9, 1, 5], [1, 1, 9, 1], [1, 1, 1, 1]]), "b": motif.log_odds([[1, 8, 1, 1, 3, 1], [1, 1, 1, 8, 3, 1], [8, 1, 1, 1, 3, 8], [1, 1, 8, 1, 3, 1]])}


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("best", [True, False])
def test_sites_equal_a_scan_of_the_whole_string(spark, best):
    rng = random.Random(9)
    genome = {c: "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(n)) for c, n in (("c", 300), ("d", 45))}
    regions = [(1, "c", 0, 300), (2, "c", 13, 40), (3, "c", 60, 66), (4, "d", 10, 60), (5, "e", 0, 10), (6, "c", 5, 5)]
    want = set()
    for i, c, low, high in regions:
        for at in range(low, min(high, len(genome.get(c, "")))):
            for name, w in WEIGHTS.items():
                n, found = w.shape[1], []
                word = genome[c][at : at + n]
                if at + n > min(high, len(genome[c])):
                    continue
                for strand, s in (("+", word), ("-", revcomp(word))):
                    score = sum(w["ACGT".index(x)][j] if x in "ACGT" else -np.inf for j, x in enumerate(s))
                    if score >= 2:
                        found.append((score, strand))
                if best and found:
                    found = [max(found, key=lambda f: (round(f[0], 9), f[1] == "+"))]
                want |= {(i, c, at, at + n, name, strand, round(score, 6)) for score, strand in found}
    chunks = tools.chunked(spark.createDataFrame(list(genome.items()), "chrom string, seq string"), 10)
    df = spark.createDataFrame(regions, "_ord long, chrom string, initial long, final long")
    got = motifs.sites_in_regions(df, chunks, 10, WEIGHTS, 2.0, best).collect()
    assert {(*r[:6], round(r.score, 6)) for r in got} == want and len(got) == len(want) > 20


def test_enrichment_of_sets_without_rows(spark):
    region = "_ord long, chrom string, initial long, final long, name string"
    site = "chrom string, initial long, final long, motif string"
    a = spark.createDataFrame([(1, "c", 0, 10, "x"), (2, "c", 20, 30, "x"), (3, "c", 40, 50, "y")], region)
    sites = spark.createDataFrame([("c", 5, 6, "m"), ("c", 25, 26, "m"), ("c", 26, 27, "m"), ("c", 99, 100, "m"), ("c", 45, 46, "k")], site)
    rows = {r.motif: r for r in motifs.enrichment(a, sites, a, sites.filter("motif = 'm'")).collect()}
    assert [tuple(rows["m"][k] for k in "abcd"), rows["m"].genes] == [(2, 1, 2, 1), 1] and [tuple(rows["k"][k] for k in "abcd"), rows["k"].genes] == [(1, 2, 0, 3), 1]
    assert abs(rows["k"].p - 0.5) < 1e-9 and rows["k"].frequency == pytest.approx(1 / 3) and rows["k"].background_frequency == 0
    nothing = {r.motif: r for r in motifs.enrichment(a, sites, a.limit(0), sites).collect()}
    assert nothing["m"].background_frequency is None and nothing["m"].p == 1.0
    assert motifs.enrichment(a, sites.limit(0), a, sites.limit(0)).count() == 0
