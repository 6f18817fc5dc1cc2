"""Link-graph propagation against dense matrices, and edge rows."""

import numpy as np
import pytest

from strandline.llm import url_filter as u
from strandline.llm.store import Shelf


def ranks(seeds, edges, n):
    """Dense personalised PageRank: mass of hosts without edges returns to the seeds."""
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[b, a] += w
    seed, rank = np.array(seeds) / sum(seeds), np.array(seeds) / sum(seeds)
    while True:
        flow = u.DAMPING * (m @ rank)
        after = flow + (1 - flow.sum()) * seed
        still = np.abs(after - rank).sum() < u.STILL
        rank = after
        if still:
            break
    return rank


def graph(n, seed):
    """(src, dst) links: some hosts link nowhere, host 0 is linked by a third of all and links to many."""
    rng = np.random.default_rng(seed)
    links = []
    for a in range(n):
        if rng.random() < 0.2 and a:
            continue
        for b in rng.integers(0, n, rng.integers(1, 6) if a else n // 3):
            links += [(a, int(b))] * int(rng.integers(1, 4))
        if rng.random() < 0.33:
            links.append((a, 0))
    return links


@pytest.mark.parametrize("n", [40, 300])
def test_propagation_equals_dense_matrices(spark, n):
    links = graph(n, n)
    kinds = ["allow" if i % 7 == 1 else "block" if i % 7 == 2 else None for i in range(n)]
    url = lambda i: f"http://h{i}.{ {'allow': 'org', 'block': 'com', None: 'net'}[kinds[i]] }/de/"
    html = {a: "".join(f'<p><a class=x href="{url(b)}">x</a>' for s, b in links if s == a) for a in range(n)}
    pages = spark.createDataFrame([(i, url(i), html[i]) for i in range(n)], "page_id long, url string, html string")
    count = {}
    for a, b in links:
        if a != b:
            count[a, b] = count.get((a, b), 0) + 1
    out = {a: sum(c for (x, _), c in count.items() if x == a) for a in range(n)}
    edges = [(a, b, c / out[a]) for (a, b), c in count.items()]
    into = {b: sum(w for _, x, w in edges if x == b) for b in range(n)}
    back = [(b, a, w / into[b]) for a, b, w in edges]
    trust = ranks([float(k == "allow") for k in kinds], edges, n)
    distrust = ranks([float(k == "block") for k in kinds], back, n)
    hosts = spark.createDataFrame([(i, url(i)) for i in range(n)], "i long, url string").select("i", u.host_of("url").alias("host"))
    named = {r.host: r.i for r in hosts.collect()}
    seeds = spark.createDataFrame([(h, 1.0 / kinds.count("allow")) for h, i in named.items() if kinds[i] == "allow"], "host string, seed double")
    found = u.host_edges(pages.select("html", u.host_of("url").alias("_host")))
    got = {named[r.host]: r["rank"] for r in u.propagate(seeds, found, Shelf(spark)).collect()}
    assert np.abs(np.array([got.get(i, 0.0) for i in range(n)]) - trust).max() < 1e-6
    verdicts = {r.page_id: r.verdict for r in u.url_filter(pages).collect()}
    for i in range(n):
        want = kinds[i] or ("block" if distrust[i] > u.FACTOR / n and distrust[i] > trust[i] else "allow")
        assert verdicts[i] == want or abs(distrust[i] - max(u.FACTOR / n, trust[i])) < 1e-6
    assert {"allow", "block"} <= {verdicts[i] for i in range(n) if kinds[i] is None}


def test_edges(spark):
    rows = [(None, None, None, "a"), (1, "", "", None), (2, "http://", "<a href='//x.y/z'>", "c"), (3, "http://A.b/?x", "<a href=http://q.r " * 50_000, "d"), (3, "http://A.b/?x", None, "d"), (4, "http://c.d/", "<a href='http://'>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = u.url_filter(pages).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} == {"allow"} and all(r.host is not None and r.path is not None for r in got)
    assert u.url_filter(pages.filter("false")).count() == 0


def test_a_chain_is_followed_to_its_end(spark):
    n = 36
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n - 1)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    got = {r.host: r.rank for r in u.propagate(seeds, edges, Shelf(spark)).collect()}
    want = ranks([1.0] + [0.0] * (n - 1), [(i, i + 1, 1.0) for i in range(n - 1)], n)
    assert len(got) == n and all(abs(got[f"h{i}"] - want[i]) < 1e-9 and want[i] > 0 for i in range(n))
