"""Runs against their definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from conftest import SF
from strandline.llm import periodic_runs as P
from strandline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(words):
    """Every maximal stretch with its smallest period, period by period."""
    n, out = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k > i and k + p - i >= max(6, 4 * p):
                out.setdefault((i, k + p - i), p)  # smaller periods come first
            i = max(k, i + 1)
    return sorted((s, m, p) for (s, m), p in out.items())


def texts(rng, many):
    for _ in range(many):
        parts = []
        for _ in range(rng.randrange(5)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            parts += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
            parts += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
        yield parts


def test_runs_equal_definition():
    rng = random.Random(3)
    some = [[], ["a"] * 5, ["a"] * 6, ["a"] * 1000, list("ab") * 4, list("ab") * 3, list("aab") * 40, *texts(rng, 400)]
    some += [[rng.choice("ab") for _ in range(rng.randrange(60))] for _ in range(300)]
    for most in (10**6, 50):
        assert [list(map(tuple, r)) for _, r in P.runs_of(some, most)] == [by_definition(w) for w in some]
    assert sum(len(by_definition(w)) > 1 for w in some) > 100


def test_extensions_equal_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300):
        words = rng.integers(0, 2, n)
        order = P.suffix_array(words)
        assert order.tolist() == sorted(range(n), key=lambda i: words[i:].tolist())
        if n < 2:
            continue
        a, b = rng.integers(0, n, 500), rng.integers(0, n, 500)
        a, b = a[a != b], b[a != b]
        scan = [next((k for k in range(n) if max(x, y) + k >= n or words[x + k] != words[y + k]), n) for x, y in zip(a, b, strict=True)]
        assert P.Extensions(words).of(a, b).tolist() == scan


def tiled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a, out = g % n, []
    p = 1 + (n - a) // (3 + g % 8)
    for i in range(n):
        out.append(words[i] if i < a else words[a + (i - a) % p])
    return out


def summary(doc_id, text):
    words = tiled(doc_id, WORD.findall(text or ""))
    runs = by_definition(words) if len(words) < 4000 else None
    if runs is None:
        return None
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(left))


def test_query_equals_definition(spark):
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: summary(*r) for r in rows}
    assert got.keys() == want.keys() and all(got[i] == w for i, w in want.items() if w is not None)
    assert sum(w is not None and w[1] > 0 for w in want.values()) > 10


def test_edge_rows(spark):
    rows = [(None, "a " * 8, 1), (1, None, 1), (1, "", 1), (2, " \n", 1), (3, "x y " * 50_000, 1), (3, "x y " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = sorted(P.periodic_runs(docs).collect(), key=str)
    plain = {(r.doc_id, r.text): [tuple(x) for x in r.runs] for r in got}
    assert len(got) == 6 and plain == {(None, "a"): [(0, 8, 1)], (1, ""): [], (2, ""): [], (3, "x y"): [(0, 100_000, 2)]}
    assert P.run_summary(docs.limit(0)).count() == 0
    assert {r.n_runs for r in P.run_summary(docs).collect()} == {0, 1}
