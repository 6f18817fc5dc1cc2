"""Bias correction, labelled and binomial hidden Markov models, placement without overlaps and gaps over blocks against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from strandline.operators import footprint, hmm, joins, placement, tools
from strandline.operators import triplex as T


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [4, 5])
def test_bias_correction_equals_position_by_position(spark, k):
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    cuts = [(rng.randrange(400), rng.choice("+-")) for _ in range(900)]
    table = {(o, w): rng.random() + 0.2 for o in "+-" for w in {genome[i : i + k] for i in range(0, 390)} if rng.random() < 0.8}
    regions = [(1, 60, 100), (2, 10, 40), (3, 330, 399), (4, 200, 201)]
    got = footprint.bias_corrected(
        spark.createDataFrame([(i, "c", a, b) for i, a, b in regions], "_ord long, chrom string, initial long, final long"),
        spark.createDataFrame([("c", p, p + 1, o) for p, o in cuts], "chrom string, initial long, final long, orientation string"),
        tools.chunked(spark.createDataFrame([("c", genome)], "chrom string, seq string"), 64), 64,
        spark.createDataFrame([(o, w, b) for (o, w), b in table.items()], "orientation string, kmer string, bias double"), window=20,
    )
    n = {o: [sum(1 for p, q in cuts if p == x and q == o) for x in range(460)] for o in "+-"}
    first = lambda x: x - k // 2 + k % 2
    word = lambda x: genome[x : x + k] if x >= 0 else ""
    bias = {"+": lambda x: table.get(("+", word(first(x))), 1.0), "-": lambda x: table.get(("-", revcomp(word(first(x) + 1))), 1.0)}
    want = {}
    for i, a, b in regions:
        for x in range(a, b):
            if a - 10 - k // 2 <= 0:
                want[i, x - a] = float(n["+"][x] + n["-"][x])
                continue
            around = range(x - 10, x + 10)
            hat = {o: sum(n[o][y] for y in around) * bias[o](x) / sum(bias[o](y) for y in around) for o in "+-"}
            want[i, x - a] = sum(math.log(n[o][x] + 1) - math.log(hat[o] + 1) for o in "+-")
    rows = {(r._ord, r.offset): r.signal for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[key] - v) < 1e-9 for key, v in want.items())


def plain_em(x, labels, model, clamp_state):
    """One round over a whole sequence."""
    like, trans = np.exp(model.emit(x, model.params)), model.trans
    n, s = like.shape
    ahead, behind = np.zeros((n, s)), np.ones((n, s))
    ahead[0] = model.start * like[0]
    for i in range(1, n):
        ahead[i] = ahead[i - 1] @ trans * like[i]
    for i in range(n - 2, -1, -1):
        behind[i] = trans @ (like[i + 1] * behind[i + 1])
    total = ahead[-1].sum()
    post = ahead * behind / total
    steps = sum(np.outer(ahead[i], like[i + 1] * behind[i + 1]) * trans for i in range(n - 1)) / total
    for i, label in enumerate(labels):
        if label == 0:
            post[i, clamp_state] = 0
            post[i] /= post[i].sum()
        elif label == 1:
            post[i] = np.eye(s)[clamp_state]
    return math.log(total), post, steps


def test_labels_clamp_chances(spark):
    rng = np.random.default_rng(2)
    n = 60
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(3, 1, (20, 2)), rng.normal(0, 1, (20, 2))])
    labels = [0] * 5 + [None] * 20 + [1] * 8 + [None] * 20 + [0] * 7
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), (((0.0, 0.0), np.eye(2)), ((2.0, 2.0), np.eye(2))), hmm.gaussian)
    df = spark.createDataFrame([("s", i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, labels, strict=True))], "k string, at long, a double, b double, lab int")
    like, post, steps = plain_em(x, labels, model, 1)
    fitted, likes = hmm.fit(df, "k", "at", ["a", "b"], model, rounds=1, block=7, clamp=("lab", 1))
    mean = post.T @ x / post.sum(axis=0)[:, None]
    assert abs(likes[0] - like) < 1e-8 and np.allclose(fitted.start, post[0] / post[0].sum()) and n == len(x)
    assert np.allclose(fitted.trans, steps / steps.sum(axis=1, keepdims=True)) and np.allclose([p[0] for p in fitted.params], mean)
    free, _ = hmm.fit(df, "k", "at", ["a", "b"], model, rounds=1, block=7)
    assert not np.allclose([p[0] for p in free.params], mean)


def test_binomial_states_rise_and_equal_plain_pass(spark):
    rng = np.random.default_rng(5)
    chance = {0: (0.05, 0.05), 1: (0.5, 0.05), 2: (0.05, 0.5)}
    path = np.repeat([0, 1, 0, 2, 0], 12)
    x = np.array([[rng.binomial(20, chance[s][0]), rng.binomial(20, chance[s][0]), rng.binomial(20, chance[s][1])] for s in path], float)
    sample = np.array([0, 0, 1])
    params = tuple((np.full(3, 20.0), np.array(p)[sample], sample) for p in ((0.1, 0.1), (0.3, 0.1), (0.1, 0.3)))
    model = hmm.Model(np.full(3, 1 / 3), np.full((3, 3), 0.1) + 0.7 * np.eye(3), params, hmm.binomial)
    logs = [[sum(math.lgamma(21) - math.lgamma(v + 1) - math.lgamma(21 - v) + v * math.log(q) + (20 - v) * math.log(1 - q) for v, q in zip(row, p[1], strict=True)) for p in params] for row in x]
    assert np.allclose(hmm.binomial(x, params), logs)
    df = spark.createDataFrame([("s", i, *map(float, row)) for i, row in enumerate(x)], "k string, at long, a double, b double, c double")
    _, post, _ = plain_em(x, [None] * len(x), model, 0)
    once, _ = hmm.fit(df, "k", "at", ["a", "b", "c"], model, rounds=1, block=9)
    mean = post.T @ x / post.sum(axis=0)[:, None] / 20
    assert all(np.allclose(p[1], [(m[0] + m[1]) / 2] * 2 + [m[2]]) for p, m in zip(once.params, mean, strict=True))
    fitted, likes = hmm.fit(df, "k", "at", ["a", "b", "c"], model, rounds=4, block=9)
    assert all(b > a - 1e-9 for a, b in zip(likes, likes[1:], strict=False))
    states = [r.state for r in hmm.decode(df, "k", "at", ["a", "b", "c"], fitted, block=9).orderBy("at").collect()]
    assert np.mean(np.array(states) == path) > 0.95
    start = hmm.binomial_start(df, "a", "c", 20)
    assert [p[1].tolist() for p in start][0] == [0.05, 0.05] and start[0][0].tolist() == [20, 20]


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def test_places_apart_equal_rounds_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, "c1", 0, rng.randrange(20, 60)) for i in range(30)]
    sizes, taken = {"c1": 900, "c2": 700}, [("c1", 100, 150), ("c2", 300, 310), ("c2", 690, 700)]
    free, at = [], 0
    for c, n in sorted(sizes.items()):
        edge = 0
        for _, i, f in [t for t in taken if t[0] == c] + [(c, n, n)]:
            if i > edge:
                free.append((at, c, edge, i))
                at += i - edge
            edge = f
    done, left = {}, list(range(30))
    for n in range(60):
        draws = {}
        for i in left:
            size = rows[i][3]
            for k in range(1, 21):
                p = hashed(1, i, k, f"1:{n}") % at
                off, c, a, b = max(f for f in free if f[0] <= p)
                if a + p - off + size <= b:
                    draws[i] = (c, a + p - off, a + p - off + size)
                    break
        meet = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        draws = {i: d for i, d in draws.items() if not any(meet(d, x) for x in done.values())}
        rank = {i: (hashed(1, i, f"1:{n}:rank"), i) for i in draws}
        won = {i: d for i, d in draws.items() if not any(rank[j] < rank[i] and meet(d, e) for j, e in draws.items() if j != i)}
        done |= won
        left = [i for i in left if i not in done]
        if not left:
            break
    df = spark.createDataFrame(rows, "_ord long, chrom string, initial long, final long")
    free_of = spark.createDataFrame(taken, "chrom string, initial long, final long")
    out = placement.place_apart(df.repartition(3), spark.createDataFrame(list(sizes.items()), "chrom string, length long"), free_of).collect()
    assert {r._ord: (r.chrom, r.initial, r.final) for r in out} == done | {i: (None,) * 3 for i in left} and len(done) > 20
    places = sorted(v for v in done.values())
    assert all(not meet(a, b) for a, b in zip(places, places[1:], strict=False))


def test_gaps_of_one_chromosome_over_many_blocks(spark):
    rng = random.Random(6)
    b = [(p, p + rng.randrange(1, 3000)) for p in (rng.randrange(1_000_000) for _ in range(120))] + [(200_000, 420_000)]
    a = [(p, p + rng.randrange(1, 150_000)) for p in (rng.randrange(1_000_000) for _ in range(12))]
    covered, inside = np.zeros(1_200_000, bool), np.zeros(1_200_000, bool)
    for i, f in b:
        covered[i:f] = True
    for i, f in a:
        inside[i:f] = True
    frame = lambda rows: spark.createDataFrame([("c", i, f) for i, f in rows], "chrom string, initial long, final long")
    got = np.zeros(1_200_000, int)
    for r in joins.subtract(frame(a), frame(b)).collect():
        got[r.initial : r.final] += 1
    assert (got == (inside & ~covered)).all()
    assert sum(r.final - r.initial for r in joins.complement(frame(b), spark.createDataFrame([("c", 1_200_000), ("d", 5)], "chrom string, length long")).collect()) == int((~covered).sum()) + 5
    assert joins.subtract(frame(a), frame([]).limit(0)).count() > 0 and joins.subtract(frame(a).limit(0), frame(b)).count() == 0


def test_switch_kinds_of_each_class(spark):
    # (rna_i, rna_f, initial, final, strand, motif, direction); the last two of the order are left out
    rows, kinds = [], []

    def add(kind, first, second):
        at, place = 1000 * len(kinds), 10_000 * len(kinds)
        for rna, (gap, *rest) in ((at, first), (at + 25, second)):
            rows.append((len(rows), rna, rna + 10, "c", place + gap, place + gap + 10, *rest))
        kinds.append(kind)

    add("C_YM", (0, "+", "Y", "P"), (12, "+", "M", "P"))
    add("C_MY", (12, "-", "M", "P"), (0, "-", "Y", "P"))
    add("C_MR", (12, "+", "M", "A"), (0, "+", "R", "A"))
    add("C_RM", (0, "-", "R", "A"), (12, "-", "M", "A"))
    add("SR_MM", (0, "+", "M", "P"), (11, "+", "M", "A"))
    add("SD_PA_pos", (0, "+", "M", "P"), (12, "-", "M", "A"))
    add("SD_AP_neg", (0, "-", "M", "A"), (12, "+", "M", "P"))
    add(None, (0, "+", "Y", "P"), (50, "+", "M", "P"))
    add(None, (0, "+", "Y", "P"), (12, "+", "Y", "P"))
    rows += [(1000 + i, 90_000 + i, 90_010 + i, "c", 0, 10, "+", "M", "P") for i in range(2)]
    df = spark.createDataFrame(rows, "_ord long, rna_i long, rna_f long, chrom string, initial long, final long, orientation string, motif string, direction string")
    got = {r.kind: r.n for r in T.switch_kinds(df).collect()}
    assert got == {k: kinds.count(k) for k in T.SWITCHES} and sum(got.values()) == 7
    assert {r.n for r in T.switch_kinds(df.limit(0)).collect()} == {0}


def test_close_windows_keep_their_distance(spark):
    regions = spark.createDataFrame([("c", 1000, 1100), ("c", 1500, 1600)], "chrom string, initial long, final long")
    background = spark.createDataFrame([(1, "c", 0, 5000), (2, "c", 900, 1200), (3, "c", 8000, 9000), (4, "c", 700, 1100)], "_ord long, chrom string, initial long, final long")
    got = {r._ord: r for r in placement.close_windows(regions, background).collect()}
    assert set(got) == {1, 4} and got[1].fits and not got[4].fits and got[4].initial == 700
    assert all(got[1].final <= i - 200 or got[1].initial >= f + 200 for i, f in ((1000, 1100), (1500, 1600))) and got[1].final - got[1].initial == 100
