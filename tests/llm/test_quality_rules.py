"""Fences from sketches against exact quantiles, and that a group's values move its own verdicts."""

import random

import numpy as np
import pytest

from conftest import SF
from strandline.llm import quality_rules as q


def ratios(r):
    return r.n_symbols / max(r.word_chars, 1), r.n_repeat_words / max(r.n_words, 1), r.word_chars / max(r.n_words, 1)


def fence(values):
    body, tail = (np.quantile(values, x, method="inverted_cdf") for x in (q.BODY, q.TAIL))
    return tail + max(q.REACH * (tail - body), q.FLOOR)


def weighed(values, above):
    return np.exp((len(values) * np.log(fence(values)) + q.WEIGHT * np.log(above)) / (len(values) + q.WEIGHT))


def expected(rows):
    """rows: (result row, lang, source). Exact quantiles in place of sketches, the same weights."""
    passed = [(ratios(r), lang, source) for r, lang, source in rows if not r.base_failed]
    out = {}
    for r, lang, source in rows:
        ok = not r.base_failed
        for i in range(3):
            every = [x[i] for x, _, _ in passed]
            of_lang = [x[i] for x, a, _ in passed if a == lang]
            own = [x[i] for x, a, b in passed if (a, b) == (lang, source)]
            if ok and own:
                ok = ok and ratios(r)[i] <= weighed(own, weighed(of_lang, fence(every)))
        out[r.doc_id] = ok
    return out


def test_verdicts_equal_exact_quantiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = {r.doc_id: (r.lang, r.source) for r in docs.select("doc_id", "lang", "source").collect()}
    got = q.quality(docs).collect()
    assert {r.doc_id: r.kept for r in got} == expected([(r, *part[r.doc_id]) for r in got])
    assert q.quality_filter(docs).count() == sum(r.kept for r in got)


def corpus(rate):
    """Two sources of plain texts and a few with symbols; rate: symbols a word in the first source."""
    rng, rows = random.Random(2), []
    for i in range(900):
        source = "ab"[i % 2]
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        often = rate if source == "a" else 0.0
        words = [w + "#" * (rng.random() < often) for w in words]
        if i % 100 < 2:
            words = [w + "#" * (rng.random() < 0.6) for w in words]  # far more than its source's own
        rows.append((i, " ".join(words), "en", source))
    return rows


def test_a_source_moves_its_own_fence(spark):
    kept = []
    for rate in (0.0, 0.6):
        rows = corpus(rate)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        kept.append({r.doc_id: r.kept for r in q.quality(docs).collect()})
    odd = [i for i in range(900) if i % 100 < 2]
    plain, others = [i for i in range(0, 900, 2) if i not in odd], [i for i in odd if i % 2]
    assert not any(kept[0][i] for i in odd) and all(kept[0][i] for i in range(900) if i not in odd)
    # As many symbols as make an outlier in source b are source a's habit now: a's plain texts stay, b's outliers still go.
    assert all(kept[1][i] for i in plain) and not any(kept[1][i] for i in others)
    assert all(kept[1][i] for i in range(1, 900, 2) if i not in odd)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_nothing_passes(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        docs = spark.createDataFrame([(1, "short", "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
        assert [(r.doc_id, r.base_failed, r.kept) for r in q.quality(docs).orderBy("doc_id").collect()] == [(1, True, False), (2, True, False)]
        assert q.quality(docs.limit(0)).count() == q.quality_filter(docs).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_partitioning_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    some = [sorted((r.doc_id, r.kept) for r in q.quality(d).select("doc_id", "kept").collect()) for d in (docs, docs.repartition(7), docs.repartition(3, "source"))]
    assert some[0] == some[1] == some[2] and not all(k for _, k in some[0])
