"""Interval operators: hand-made cases, and every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from conftest import SF
from strandline.operators import islands, joins, project, stats
from strandline.plans import registry
from strandline.sources import bed


def df(spark, rows):
    return spark.createDataFrame([("c1", a, b, i) for i, (a, b) in enumerate(rows)], "chrom string, initial long, final long, _ord long")


def got(d):
    return sorted((r.initial, r.final) for r in d.collect())


def test_merge_across_blocks(spark):
    rows = [(1, 70000), (2, 3), (65000, 66000), (69999, 140000), (140000, 140001), (300000, 300010)]
    assert got(islands.merge(df(spark, rows))) == [(1, 140000), (140000, 140001), (300000, 300010)]


def test_intersect_keeps_all_pairs(spark):
    assert got(joins.intersect(df(spark, [(1, 10), (20, 30)]), df(spark, [(0, 100), (200, 300)]))) == [(1, 10), (20, 30)]


def test_subtract(spark):
    assert got(joins.subtract(df(spark, [(0, 10), (20, 30), (40, 50)]), df(spark, [(5, 7), (15, 22), (40, 50)]))) == [(0, 5), (7, 10), (22, 30)]


def test_semi_anti(spark):
    a, b = df(spark, [(0, 10), (0, 10), (20, 30)]), df(spark, [(9, 12)])
    assert got(joins.semi(a, b)) == [(0, 10), (0, 10)] and got(joins.semi(a, b, anti=True)) == [(20, 30)]


def test_extend_swaps(spark):
    assert got(project.extend(df(spark, [(10, 12)]), -5, -5)) == [(7, 15)]


def test_empty(spark):
    e = df(spark, [(0, 1)]).filter("false")
    assert got(islands.merge(e)) == [] and got(joins.subtract(df(spark, [(1, 2)]), e)) == [(1, 2)] and stats.depth(e).count() == 0


def test_bed_round_trip(spark, tmp_path):
    (tmp_path / "x.bed").write_text("c1\t10\t5\tn\t3\t+\nbad\nc1 7 7\nc2 1 2\n")
    rows = bed.read_bed(spark, str(tmp_path / "x.bed"))
    assert got(rows) == [(1, 2), (5, 10)]
    bed.write_bed(rows, str(tmp_path / "out"))
    assert got(bed.read_bed(spark, str(tmp_path / "out"))) == [(1, 2), (5, 10)]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    frame = registry.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    mine = sorted([tuple(r[c] for c in cols) for r in frame.collect()], key=str)
    res = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    theirs = sorted([tuple(r[names.index(c)] for c in cols) for r in res.fetchall()], key=str)
    assert sorted(names) == cols and mine == theirs
