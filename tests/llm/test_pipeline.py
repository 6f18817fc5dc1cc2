"""Line dedup and the pipeline's stages against brute force on a whole table with planted cases."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from conftest import SF
from strandline.llm import best_fit_packing, line_dedup, quality_rules, secret_scan
from test_llm import WORD, shingle_set
from test_quality_rules import expected


def without_runs(texts):
    """{id: text} with the lines of every run of RUN words or more that stands earlier deleted: all pairs of equal lines are starts, and
    matches are extended line by line as far as they go."""
    lines = [(i, n, " ".join(WORD.findall(x))) for i in sorted(texts) for n, x in enumerate(texts[i].split("\n"))]
    last = {i: n for i, n, _ in lines}
    places, gone = defaultdict(list), set()
    for q, (_, n, x) in enumerate(lines):
        for p in places[x]:
            if n and lines[p][1] and lines[p - 1][2] == lines[q - 1][2]:
                continue  # inside a match that began before
            k, words = 0, 0
            while lines[p + k][2] == lines[q + k][2]:
                words += len(lines[q + k][2].split())
                if lines[p + k][1] == last[lines[p + k][0]] or lines[q + k][1] == last[lines[q + k][0]]:
                    k += 1
                    break
                k += 1
            if words >= line_dedup.RUN:
                gone |= set(range(q, q + k))
        places[x].append(q)
    out = defaultdict(list)
    for q, (i, n, _) in enumerate(lines):
        if q not in gone:
            out[i].append(texts[i].split("\n")[n])
    return {i: "\n".join(out[i]) for i in texts}


def table(spark):
    """The documents of the smallest tables, and planted ones: copies, near copies, passages that repeat, secrets."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = "\n".join(line(12) for _ in range(5))
    key = "MC4CAQAwBQYDK2VwBCIEINTuctv5E1hK1bbY8fdp+K06/nwoy/HU++CXqI9EdVhC"
    base = "\n".join(line(11) for _ in range(9))
    made = [base, base, base.replace(base.split()[40], "other"), f"{line(60)}\n{passage}\n{line(20)}", f"{line(70)}\n{passage}", f"{line(55)}\nkey {key}\npassword = 'abcdefgh12345'", "", "tiny", None]
    return rows + [(10**6 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(made)], docs.schema


def components(texts):
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("many", [False, True])
def test_line_dedup_equals_extended_matches(spark, many):
    rows, _ = table(spark)
    texts = {r[0]: r[1] or "" for r in rows}
    if many:  # passages cut and mixed, so runs overlap and repeat in parts
        rng = random.Random(5)
        some = [x for t in list(texts.values())[:60] for x in t.split("\n")][:120]
        piece = lambda at: some[at : at + rng.randrange(1, 12)]
        texts = {i: "\n".join(x for _ in range(rng.randrange(1, 5)) for x in piece(rng.randrange(110))) for i in range(250)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    want = without_runs(texts)
    assert got == want and sum(got[i] != texts[i] for i in texts) > 5


def test_stages_equal_brute_force(spark):
    rows, schema = table(spark)
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    part = {r[0]: (r[2], r[3]) for r in rows}

    kept = stage["quality_rules"](spark, docs, SF)
    now = texts(kept)
    verdict = expected([(r, *part[r.doc_id]) for r in quality_rules.quality(docs).collect()])
    assert set(now) == {i for i, ok in verdict.items() if ok} and all(now[r[0]] == r[1] for r in rows if r[0] in now)

    kept = stage["line_dedup"](spark, kept, SF)
    want = {i: t for i, t in without_runs(now).items() if t == now[i] or WORD.search(t)}
    now = texts(kept)
    assert now == want and all(r.n_chars == len(r.text) for r in kept.collect())

    kept = stage["minhash_near_dedup"](spark, kept, SF)
    want = {i: now[i] for i, c in components(now).items() if i == c}
    now = texts(kept)
    assert now == want

    kept = stage["secret_scan"](spark, kept, SF)
    clean = texts(kept)
    for i, t in now.items():
        found, out, end = secret_scan.spans(t)[1], [], 0
        for a, k, b in found:
            if a >= end:
                out += [t[end:a], f"<{secret_scan.KINDS[k]}>"]
            end = max(end, b)
        assert clean[i] == "".join(out) + t[end:]
    assert "<asn1>" in clean[10**6 + 5] and "<assign>" in clean[10**6 + 5]

    placed = stage["best_fit_packing"](spark, kept, SF).collect()
    length = defaultdict(int)
    for r in placed:
        length[r.doc_id] += r.length
        assert r.bin < 0 or r.offset + r.length <= best_fit_packing.CAPACITY
    assert dict(length) == {i: len(WORD.findall(t)) for i, t in clean.items()}
