"""Hand-made and brute-force cases of relations, exact tests, motif scans, sources and streaming."""

import math
import random

import numpy as np
import pytest

from conftest import SF
from strandline.functions import motif
from strandline.operators import association, islands, peaks, relations, significance
from strandline.plans import model_queries, registry
from strandline.sources import text
from strandline.streaming import coverage
from test_intervals import df


def test_merge_with_repeated_rows_at_island_starts(spark):
    rng = random.Random(4)
    rows = [(p, p + 5) for p in (rng.randrange(0, 4000) for _ in range(1500)) for _ in range(3)]
    want, end = [], -1
    for a, b in sorted(rows):
        if a >= end:
            want.append([a, b, 0])
        want[-1][1], want[-1][2] = max(want[-1][1], b), want[-1][2] + 1
        end = want[-1][1]
    got = islands.merge(df(spark, rows).repartition(7)).collect()
    assert sorted((r.initial, r.final, r.n) for r in got) == [tuple(w) for w in want]
    small = islands.with_islands(df(spark, rows), block=64).groupBy("_island").count().collect()
    assert sorted(r["count"] for r in small) == sorted(w[2] for w in want)


def test_adjacent_runs_break_on_change(spark):
    rows = spark.createDataFrame([("c", 0, 10, 1, "x"), ("c", 5, 15, 2, "y"), ("c", 8, 20, 3, "x"), ("c", 70000, 70001, 4, "x")], "chrom string, initial long, final long, _ord long, name string")
    got = sorted((r.initial, r.final, r.name) for r in relations.merge_adjacent(rows, "name").collect())
    assert got == [(0, 10, "x"), (5, 15, "y"), (8, 20, "x"), (70000, 70001, "x")]


def test_empty_inputs(spark):
    a, e = df(spark, [(0, 10)]).withColumns({"orientation": islands.F.lit("+"), "name": islands.F.lit("g")}), None
    e = a.filter("false")
    assert relations.remnants(a, e).count() == 1 and association.distances(a, e, 100).count() == 0 and relations.overlap_flag(a, e).first().hit == "N"
    assert relations.tss(e).count() == 0 and relations.merge_adjacent(e, "name").count() == 0
    row = significance.projection_test(a, e, 100).first()
    assert (row.k, row.n, row.p_value) == (0, 0, 1.0)


def test_binomial_matches_direct_sum():
    for n, p in ((1, 0.3), (10, 0.5), (23, 0.07), (60, 0.61), (200, 0.01)):
        pmf = [math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(n + 1)]
        for k in range(n + 1):
            want = sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7))
            assert significance.binomial_two_sided(k, n, p) == pytest.approx(min(1, want), rel=1e-6, abs=1e-12), (k, n, p)


def test_fisher_matches_direct_sum():
    rng = random.Random(5)
    for _ in range(200):
        a, b, c, d = (rng.randrange(0, 12) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        want = sum(math.comb(col, k) * math.comb(n - col, row - k) for k in range(a, min(row, col) + 1)) / math.comb(n, row)
        assert significance.fisher_tail(a, b, c, d) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_motif_scan_both_strands(spark):
    w = motif.log_odds([[9, 0, 0], [0, 9, 0], [0, 0, 9], [0, 0, 0]])
    rows = spark.createDataFrame([(1, "TTACGTTCGTAA"), (2, "AC"), (3, None), (4, "")], "doc_id long, seq string")
    got = sorted((r.doc_id, r.strand, r.start) for r in motif.scan(rows, "doc_id", {"m": w}, 5.0).collect())
    assert got == [(1, "+", 2), (1, "-", 3), (1, "-", 7)]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_give_probabilities(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert all(0 <= v <= 1 for r in rows for k, v in r.asDict().items() if k in ("q", "p_value"))


def test_differential_peaks_equal_plain_python(spark):
    """The likeliest path of each chromosome, position by position; runs of a state, tested, cut, joined."""
    model, bins = model_queries.three_states(), {}
    for r in model_queries.planted(spark, SF).collect():
        bins.setdefault(r.chrom, []).append((r.bin, r.x, r.y))
    tests, paths = [], {}
    for chrom, rows in bins.items():
        rows.sort()
        like = model.emit(np.array([x[1:] for x in rows], dtype=float), model.params)
        score, back = np.log(model.start) + like[0], []
        for step in like[1:]:
            ways = score[:, None] + np.log(model.trans)
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + step
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        paths[chrom] = dict(zip((x[0] for x in rows), path[::-1], strict=True))
        for at, x, y in rows:
            state = paths[chrom][at]
            if state:
                tests.append((chrom, "+" if state == 1 else "-", at, x, y, peaks.conditional_p(*((y, x) if state == 1 else (x, y)), 0.2)))
    cut = float(np.percentile([t[5] for t in tests], 70))
    runs = []
    for chrom, sign, at, x, y, p in sorted(tests):
        if p <= cut:
            continue
        if runs and runs[-1][:2] == [chrom, sign] and runs[-1][3] == at * 1000:
            runs[-1][3:7] = [at * 1000 + 1000, runs[-1][4] + 1, runs[-1][5] + x, runs[-1][6] + y]
        else:
            runs.append([chrom, sign, at * 1000, at * 1000 + 1000, 1, x, y])
    want = []
    for r in runs:
        x, y = r[5:7]
        r.append(peaks.conditional_p(*((y, x) if r[1] == "+" else (x, y)), 0.2))
        if want and want[-1][:2] == r[:2] and r[2] - 2000 < want[-1][3]:
            last = want[-1]
            last[3:] = [max(last[3], r[3]), last[4] + 1, last[5] + x, last[6] + y, max(last[7], r[7])]
        else:
            want.append([*r[:4], 1, *r[5:]])
    got = model_queries.differential_peaks(spark, SF).select("chrom", "orientation", "initial", "final", "n", "x", "y", "p").collect()
    got.sort(key=lambda r: r[:3])
    want.sort(key=lambda r: r[:3])
    assert [tuple(r[:7]) for r in got] == [tuple(r[:7]) for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want], abs=2e-6)
    assert {r.orientation for r in got} == {"+", "-"} and len({r.final - r.initial for r in got}) > 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\tHAVANA\texon\t11\t20\t.\t-\t.\tgene_id "G1.4"; transcript_id "T1.2"; gene_type "x"; gene_name "N";\nbad\n')
    row = text.read_gtf(spark, str(tmp_path / "a.gtf"), "havana", "x").first()
    assert (row.initial, row.final, row.gene_id, row.transcript_id, row.gene_name) == (10, 20, "G1", "T1", "N")
    seqs = spark.createDataFrame([("s1", "+", "AC" * 100), ("s2", "-", "GT")], "name string, orientation string, seq string")
    text.write_fasta(seqs.coalesce(1), str(tmp_path / "fa"))
    got = sorted((r.orientation, r.seq) for r in text.read_fasta(spark, str(tmp_path / "fa")).collect())
    assert got == [("+", "AC" * 100), ("-", "GT")]
    (tmp_path / "x.bg").write_text("c1\t0\t5\t1.5\nc1\t0\t5\nc1\tx\t5\t1\n")
    assert [tuple(r) for r in text.read_bedgraph(spark, str(tmp_path / "x.bg")).collect()] == [("c1", 0, 5, 1.5)]
    (tmp_path / "x.bed12").write_text("c1\t100\t200\tt\t0\t+\t100\t200\t0\t2\t10,20,\t0,80,\n")
    assert sorted((r.initial, r.final) for r in text.bed12_blocks(spark, str(tmp_path / "x.bed12")).collect()) == [(100, 110), (180, 200)]
    (tmp_path / "g").write_text("abc.1 2.5\n\nd,e\n")
    assert sorted((r.gene, r.value) for r in text.read_genes(spark, str(tmp_path / "g")).collect()) == [("ABC", 2.5), ("D", None)]


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'c' AS chrom, id * 10 AS initial, timestamp_seconds(id) AS ts FROM range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = coverage.windowed_bins(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 500, "1 minute", "10 seconds")
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.bin, r.n) for r in spark.table("bins").collect()) == [(0, 50), (1, 10), (1, 40)]
