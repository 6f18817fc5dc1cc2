"""Block-wise HMMs against whole-sequence passes; peaks, ranks and tests against plain Python."""

import math
from functools import partial

import numpy as np
import pytest

from strandline.operators import hmm, peaks
from test_intervals import df

MODEL = hmm.Model(np.array([0.6, 0.3, 0.1]), np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.1, 0.7]]), ((2.0, 2.0), (8.0, 2.0), (2.0, 8.0)), hmm.poisson)


def _rows(n=150, seed=3):
    rng = np.random.default_rng(seed)
    return [(c, i, int(x), int(y)) for c in ("a", "b") for i, (x, y) in enumerate(zip(rng.poisson(np.where(np.arange(n) // 20 % 2, 8, 2)), rng.poisson(2, n), strict=True))]


def _viterbi(x, model):
    like, trans = model.emit(x, model.params), np.log(model.trans)
    score, back = np.log(model.start) + like[0], []
    for row in like[1:]:
        step = score[:, None] + trans
        back.append(step.argmax(0))
        score = step.max(0) + row
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _obs(spark, rows):
    return spark.createDataFrame(rows, "chrom string, bin long, x long, y long")


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_decode_equals_whole_pass(spark, block):
    rows = _rows()
    got = {(r.chrom, r.bin): r.state for r in hmm.decode(_obs(spark, rows), "chrom", "bin", ["x", "y"], MODEL, block).collect()}
    for c in ("a", "b"):
        x = np.array([r[2:] for r in rows if r[0] == c], dtype=float)
        assert [got[c, i] for i in range(len(x))] == _viterbi(x, MODEL)


def test_decode_of_nothing_and_of_nulls(spark):
    assert hmm.decode(_obs(spark, []), "chrom", "bin", ["x", "y"], MODEL).count() == 0
    assert hmm.decode(_obs(spark, [("a", 0, None, 1)]), "chrom", "bin", ["x", "y"], MODEL).count() == 1


def test_expectations_do_not_depend_on_blocks(spark):
    obs = _obs(spark, _rows(40))
    total = lambda block: np.sum([r.stats for r in hmm.expectations(obs, "chrom", "bin", ["x", "y"], MODEL, block).collect()], axis=0)
    one, many = total(4096), total(6)
    assert np.allclose(one, many)
    assert math.isclose(one[3:12].sum(), 2 * 39) and math.isclose(one[12:15].sum(), 2 * 40)


def test_fit_raises_the_likelihood(spark):
    model, likes = hmm.fit(_obs(spark, _rows(80)), "chrom", "bin", ["x", "y"], MODEL, 3, (np.array([0, 2, 1]), np.array([1, 0])), 32)
    assert len(likes) == 3 and likes[1] <= likes[2] + 1e-6  # the model is symmetric from the second round on
    assert np.allclose(model.trans.sum(axis=1), 1) and np.allclose(model.params[1], model.params[2][::-1])


def test_gaussian_and_negative_binomial_densities():
    got = hmm.gaussian(np.array([[1.0, 2.0]]), (((0, 0), np.eye(2)),))[0, 0]
    assert math.isclose(got, -math.log(2 * math.pi) - 2.5)
    m, alpha = 4.0, 0.5
    nb = lambda k: math.exp(math.lgamma(k + 2) - math.lgamma(2) - math.lgamma(k + 1)) * (m / (m + 2)) ** k * (2 / (m + 2)) ** 2
    x = np.arange(6).reshape(-1, 1)
    got = hmm.negative_binomial(x, (((m,), alpha),))[:, 0] - np.array([math.lgamma(k + 1) for k in range(6)])
    assert np.allclose(got, [math.log(nb(k)) for k in range(6)])


def test_conditional_p_by_enumeration():
    alpha, r = 0.3, 1 / 0.3
    pmf = lambda k: math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1))
    for x, y in ((0, 9), (3, 11), (5, 5), (0, 0)):
        n = x + y
        half = [pmf(i) * pmf(n - i) for i in range(n // 2 + 1)]
        want = -math.log10(sum(half[: x + 1]) / (2 * sum(half)))
        assert math.isclose(peaks.conditional_p(x, y, alpha), want, abs_tol=1e-9)


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(v)) for s in "pq" for i, v in enumerate(rng.integers(0, 12, 60))]
    got = peaks.quantile_normalised(spark.createDataFrame(rows, "sample string, key long, value double"), "sample", "key", "value", 2.0).collect()
    order = {s: sorted((v, i) for t, i, v in rows if t == s) for s in "pq"}
    want = {(s, i): (order["p"][k][0] + order["q"][k][0]) / 2 for s in "pq" for k, (v, i) in enumerate(order[s])}
    assert {(r["sample"], r.key): r.value for r in got} == want


def test_resplit_keeps_all_rows_and_the_size(spark):
    from pyspark.sql import functions as F

    a = df(spark, [(10 * i, 10 * i + 5) for i in range(30)]).withColumn("_ord", F.monotonically_increasing_id())
    left, right = peaks.resplit(a, a, 4, 20)
    assert left.groupBy("rep").count().filter("count <> 20").count() == 0 and left.count() == 80 and right.count() == 160
    row = peaks.resplit_test(a, a, 4, 30).first()
    assert row.both == 30 and row.a_only == 0 and row.b_only == 0 and (row.p is None or 0 <= row.p <= 1)


def test_differential_peaks(spark):
    rows = [("c", b, 1, 30, 2) for b in (3, 4, 5)] + [("c", 9, 2, 1, 25), ("c", 11, 1, 4, 3), ("c", 12, 0, 0, 0)]
    got = peaks.peaks(spark.createDataFrame(rows, "chrom string, bin long, state int, x long, y long"), 100, 0.1, 0.2).collect()
    assert sorted((r.initial, r.final, r.orientation, r.x, r.y) for r in got) == [(300, 600, "+", 90, 6), (900, 1000, "-", 1, 25)]
    assert all(r.p > 1 for r in got)
    empty = peaks.peaks(spark.createDataFrame([], "chrom string, bin long, state int, x long, y long"), 100, 0.1)
    assert empty.count() == 0


def test_footprints(spark):
    found = df(spark, [(100, 104), (300, 330), (900, 950)])
    got = sorted(tuple(r) for r in peaks.footprints(found, df(spark, [(0, 400)]), df(spark, [(90, 95), (310, 311)]), 10, 5, 20).collect())
    assert [r[1:] for r in got] == [(95, 109, 1), (300, 330, 1)]


def test_activity(spark):
    rows = spark.createDataFrame([("m", 0.0, 1.0, 0.0, 1.0), ("n", 0.5, 0.5, 0.5, 0.5), ("o", 1.0, 0.0, 1.0, 0.0)], "name string, ps_1 double, ps_2 double, tc_1 double, tc_2 double")
    got = {r.name: r for r in peaks.activity_change(rows, "name").collect()}
    close = partial(math.isclose, abs_tol=1e-9)
    assert close(got["m"].activity, 2) and close(got["n"].z, 0) and close(got["n"].p, 1) and close(got["o"].z, -math.sqrt(1.5))
