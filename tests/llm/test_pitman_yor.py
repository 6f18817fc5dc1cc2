"""The language model against its definition, against sampling seat by seat, and on edge rows."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF
from strandline.llm import pitman_yor as py
from strandline.llm import queries, store

WORD = re.compile("[^\x20\x09-\x0d]+")


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]


def score(spark, rows):
    return {r.doc_id: r for r in py.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_columns_match_brute_force_and_the_model_beats_the_base(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_pitman_yor(spark, SF).collect()
    assert len(rows) == len(texts)
    count = Counter(t for i, x in texts.items() if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    for r in rows:
        toks = tokens(texts[r.doc_id])
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (held(r.doc_id), n, len(toks), sum(count[t] > 0 for t in toks))
        assert abs(r.base_score - sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks)) < 1e-6
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_predictive_probabilities_sum_to_one_after_every_context(spark):
    """With s the score of a text and a(w) = p(w | start), p(v | w) is s("w v") a(v) / (a(w) s("v")) and p(end | w) is s("w") / a(w).
    That they sum to one for every w gives a; then the start's own must sum to one as well, the unknown word always among them."""
    words = ["aa", "ab", "ac", "ad", "zz"]  # zz is never trained
    train, out = [i for i in range(400) if not held(i)][:60], [i for i in range(400, 2000) if held(i)]
    asked = ["", *words, *(f"{w} {v}" for w in words for v in words)]
    rows = [(i, " ".join(words[(i * k + k * k) % 4] for k in range(i % 7))) for i in train] + list(zip(out, asked, strict=False))
    got = score(spark, rows)
    p = {t: 10 ** got[i].score for i, t in zip(out, asked, strict=False)}
    assert len(p) == len(asked)
    m = np.array([[p[f"{w} {v}"] / p[v] for v in words] for w in words])
    a = np.linalg.solve(np.eye(len(words)) - m, np.array([p[w] for w in words]))
    assert (a > 0).all() and abs(a.sum() + p[""] - 1) < 1e-4


def test_tables_follow_their_exact_law():
    """S(c, t) counts seatings: against all seatings listed one customer after another."""
    d, c, rng = 0.75, 6, np.random.default_rng(0)
    weight = {(1,): 1.0}
    for _ in range(c - 1):
        after = defaultdict(float)
        for sizes, w in weight.items():
            for i, n in enumerate(sizes):
                after[(*sizes[:i], n + 1, *sizes[i + 1 :])] += w * (n - d)
            after[(*sizes, 1)] += w
        weight = after
    own, up, scale = 2.0, 3.0, 0.1
    want = np.zeros(c + 1)
    for sizes, w in weight.items():
        t = len(sizes)
        want[t] += w * np.prod([(own + d * k) * (up + k - 1) * scale for k in range(1, t)])
    n = 200_000
    got = py.seat(np.full(n, c), np.full(n, own), np.full(n, up), 1.0, scale, d, rng)
    assert np.abs(np.bincount(got, minlength=c + 1) / n - want / want.sum()).max() < 0.005
    # Beyond EXACT customers the rest sit down in groups: close to the exact law of the same count.
    close = py.seat(np.full(4000, 180), np.full(4000, own), np.full(4000, up), 1.0, scale, d, rng)
    logs = py.stirling(d, 180)[180, 1:]
    logs[1:] += np.cumsum([np.log((own + d * k) * (up + k - 1) * scale) for k in range(1, 180)])
    p = np.exp(logs - logs.max())
    mean = (p * np.arange(1, 181)).sum() / p.sum()
    assert abs(close.mean() - mean) < 0.15 * mean


class Seats:
    """Plain Python: customers leave and sit down one at a time."""

    def __init__(self, d, strength, parent):
        self.d, self.s, self.parent = d, strength, parent
        self.tables, self.n, self.t = defaultdict(list), 0, 0

    def p(self, w):
        x = self.tables.get(w, [])
        return (sum(x) - self.d * len(x) + (self.s + self.d * self.t) * self.parent.p(w)) / (self.s + self.n)

    def add(self, w):
        x = self.tables[w]
        at = random.choices(range(len(x) + 1), [k - self.d for k in x] + [(self.s + self.d * self.t) * self.parent.p(w)])[0]
        self.n += 1
        if at == len(x):
            x.append(0)
            self.t += 1
            self.parent.add(w)
        x[at] += 1

    def drop(self, w):
        x = self.tables[w]
        at = random.choices(range(len(x)), x)[0]
        x[at] -= 1
        self.n -= 1
        if not x[at]:
            del x[at]
            self.t -= 1
            self.parent.drop(w)


class Uniform:
    def __init__(self, v):
        self.v = v

    def p(self, w):
        return 1 / (self.v + 1)

    def add(self, w):
        pass

    drop = add


def test_scores_equal_those_of_sampling_seat_by_seat(spark):
    random.seed(4)
    texts = {r.doc_id: " ".join((r.text or "").split()[:120]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {t for i, x in texts.items() if not held(i) for t in tokens(x)}
    root = Seats(py.ROOT_DISCOUNT, py.ROOT_STRENGTH, Uniform(len(seen)))
    rooms = defaultdict(lambda: Seats(py.DISCOUNT, py.STRENGTH, root))
    pairs = [(u, w) for i, x in texts.items() if not held(i) for u, w in zip(["", *tokens(x)], tokens(x), strict=False)]
    for u, w in pairs:
        rooms[u].add(w)
    probabilities = defaultdict(float)
    asked = {i: list(zip(["", *tokens(x)], tokens(x), strict=False)) for i, x in texts.items() if held(i)}
    for sweep in range(6):
        for u, w in pairs:
            rooms[u].drop(w)
            rooms[u].add(w)
        if sweep >= 2:
            for u, w in {x for xs in asked.values() for x in xs}:
                probabilities[u, w] += (rooms[u].p(w) if u in rooms else root.p(w)) / 4
    want = {i: sum(np.log10(probabilities[x]) for x in xs) for i, xs in asked.items()}
    got = score(spark, list(texts.items()))
    n = sum(len(x) for x in asked.values())
    assert abs(sum(got[i].score - want[i] for i in want)) / n < 0.01
    assert max(abs(got[i].score - want[i]) / len(asked[i]) for i in want) < 0.1


def test_cells_and_blocks_only_deal_the_work(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(120)]
    one = score(spark, rows)
    monkeypatch.setattr(py, "BLOCK_CHARS", 300)
    monkeypatch.setattr(py, "CELL_CHARS", 300)
    many = score(spark, rows)
    for i in one:
        assert one[i][:5] == many[i][:5] and abs(one[i].base_score - many[i].base_score) < 1e-9
    assert abs(sum(one[i].score - many[i].score for i in one)) / sum(r.n_tokens for r in one.values()) < 0.02


@pytest.mark.parametrize("ids", [(-(1 << 63), (1 << 63) - 1), (7, 7)])
def test_edges(spark, ids):
    rows = [(ids[0], None), (ids[1], "A b\tc"), (None, ""), (None, "a b c"), (5, "x " * 30_000), (5, "x " * 30_000)]
    docs = spark.createDataFrame([(*r, "t", 1, "u") for r in rows], "doc_id long, text string, block string, cell long, places string")
    assert py.scores(docs).count() == len(rows) and py.scores(docs.filter("false")).count() == 0


def test_tables_go_when_nothing_needs_them(spark, monkeypatch):
    def kinds():
        return [x for at, _, _ in os.walk(store.SHELVES[-1].removeprefix("file:")) for x in [os.path.basename(at)] if x.startswith("kind=")]

    steps, put = [], store.Shelf.put

    def watched(self, df, by=None):
        before = kinds()
        steps.append((df.columns, before))
        return put(self, df, by)

    monkeypatch.setattr(store.Shelf, "put", watched)
    monkeypatch.setattr(py, "BLOCK_CHARS", 300)
    monkeypatch.setattr(py, "CELL_CHARS", 300)
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(120)]
    got = py.scores(spark.createDataFrame(rows, "doc_id long, text string"))
    late = [before for columns, before in steps if "answer_block" in columns or "score" in columns]
    assert len(late) == 2 * py.TURNS and not {"kind=keys", "kind=active", "kind=sums"} & {k for x in late for k in x}
    assert [x.count("kind=state") for x in late] == [*range(py.TURNS, 0, -1), *[0] * py.TURNS]
    assert not kinds() and got.count() == len(rows)  # just the scores are left
