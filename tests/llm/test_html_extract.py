"""Page differencing against brute force, and on edge rows."""

import random
from collections import defaultdict

import pytest

from conftest import SF
from strandline.llm import html_extract as h
from strandline.llm import queries


def expected(pages):
    """Every page with its two neighbours on either side, without runs: votes of those that have text of their own."""
    out, hosts = {}, defaultdict(list)
    for pid, host, path, html in pages:
        hosts[host].append((path, pid, h.lines_of(html or "")))
    for rows in hosts.values():
        rows.sort(key=lambda r: (r[0], r[1]))
        for i, (_, pid, lines) in enumerate(rows):
            votes, voters = [0] * len(lines), 0
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if j == i:
                    continue
                other = rows[j][2]
                # The earlier page stands first, as ties between subsequences depend on the order.
                a, b = (other, lines) if j < i else (lines, other)
                x, y = h.common([t for t, _, _ in a], [t for t, _, _ in b])
                mine, theirs = (y, x) if j < i else (x, y)
                if {k for k, l in enumerate(lines) if not l[1]} - mine and {k for k, l in enumerate(other) if not l[1]} - theirs:
                    voters += 1
                    for k in mine:
                        votes[k] += 1
            marked = any(x and not o for _, o, x in lines)
            out[pid] = "\n".join(t for (t, o, x), v in zip(lines, votes, strict=True) if not o and (x or not marked) and not (v == 4 if marked else v and 2 * v >= voters))
    return out


def table(spark, rows):
    return spark.createDataFrame([(p, f"http://{host}{path}?q", html) for p, host, path, html in rows], "page_id long, url string, html string")


def site(n, seed):
    rng, rows = random.Random(seed), []
    words = lambda k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(k))
    for i in range(n):
        host = "hot.example" if rng.random() < 0.6 else f"h{rng.randrange(4)}.example"
        own = [words(rng.randrange(3, 9)) for _ in range(rng.randrange(4))]
        if rng.random() < 0.2 and rows:
            own = [x for x in rows[-1][4]]  # a copied article
        body = [f"Welcome to {host}", "Read more", *own, rng.choice(["The licence of all", "Other words"]), f"Made by {host}"]
        tag = "article" if i % 5 == 0 else "div"
        html = "".join(f"<{tag}><p>{x}</p></{tag}>" for x in body) if i % 11 else None
        rows.append((i, host, f"/{rng.choice('ab')}/{rng.randrange(n // 2)}", html, own))
    return [r[:4] for r in rows]


@pytest.mark.parametrize("size", [4000, 7, 3])
def test_equals_brute_force_wherever_runs_end(spark, monkeypatch, size):
    rows = site(160, 3)
    monkeypatch.setattr(h, "RANGE", size)
    got = {r.page_id: r.text for r in h.extract(table(spark, rows)).collect()}
    assert got == expected(rows)
    site_lines = {"Read more"} | {f"Welcome to {r[1]}" for r in rows}
    plain = [i for i, host, _, html in rows if html and "<article>" not in html and host == "hot.example"]
    assert sum(not site_lines & set(got[i].split("\n")) for i in plain) > 0.9 * len(plain)


def test_repeated_and_copied_pages_keep_their_text(spark):
    page = "<div>Menu of all</div><p>one own text</p><p>and two</p>"
    rows = [(i, "x.example", f"/{i}", page) for i in range(4)] + [(9, "y.example", "/1", page)]
    got = h.extract(table(spark, rows + rows[:1])).collect()
    assert len(got) == 6 and {r.text for r in got} == {"Menu of all\none own text\nand two"}


def test_a_line_that_all_neighbours_share_goes_from_articles(spark):
    rows = [(i, "x.example", f"/{i}", f"<article><p>Sign up now</p><p>text {i} of its own</p></article>") for i in range(7)]
    got = {r.page_id: r.text for r in h.extract(table(spark, rows)).collect()}
    assert all(got[i] == f"text {i} of its own" for i in (2, 3, 4)) and got[0] == "Sign up now\ntext 0 of its own"


def test_edges(spark):
    rows = [(None, None, None, "1"), (1, "nothing", "", "2"), (2, "http://a/b", "<p>x " + "y " * 300_000, "3"), (2, "http://a/b", "<p>x", "4"), (2, "http://a/b", "<p>x", "4"), (3, "http://a/c", "<<<>&#xZZ;&amp", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, run string")
    got = h.extract(docs).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[None] == "" and h.extract(docs.filter("false")).count() == 0


def test_tables_keep_articles(spark):
    got = {r.page_id: r.text for r in queries.op8_html_extract(spark, SF).collect()}
    assert got and all("&copy;" not in t and t for t in got.values())
