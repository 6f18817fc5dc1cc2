"""Row ids of the views, and SQL that gives one answer whatever the number of threads."""

import glob
import os

import duckdb
import pytest

from conftest import SF
from strandline.plans import registry, views


@pytest.mark.parametrize("name", ["reads", "reg_a", "reg_b", "genes"])
def test_row_ids_are_unique(spark, name):
    df = getattr(views, name)(spark, "/root/testdata/sf0.1")
    assert df.count() == df.select("_ord").distinct().count()


@pytest.mark.parametrize("name", ["triplex_domains", "map_names", "overlap_profile", "merge_intervals", "trim_to_union", "subtract_unmerged"])
def test_sql_has_one_answer(name):
    answers = set()
    for threads in (1, 3, 8):
        con = duckdb.connect(config={"threads": threads})
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        answers.add(str(sorted(con.execute(registry.ORACLE_SQL[name]).fetchall(), key=str)))
    assert len(answers) == 1
