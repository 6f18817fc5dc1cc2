"""Extra columns with clashing names, null and repeated ids, ties and very long texts, for operators and pipeline stages."""

import public_tokenizers as files
import pytest

import corpus_pipeline
from strandline.llm import best_fit_packing, cross_tokenizer, cutting_stock, exact_dedup, html_extract, line_dedup, minhash_dedup, periodic_runs, pitman_yor, quality_rules, queries, secret_scan, sentencepiece_bpe, store, url_filter

#: Names that the operators use inside.
CLASH = "id key n k tid fp lead comp cell block run own host path row m _m base_failed kept _kept _removed _found match_k kept_id shard cluster bytes _bytes low high text_ w lang_ a b sweep rule _rule".split()
OPERATORS = {
    "line": line_dedup.line_dedup, "piece": lambda d: sentencepiece_bpe.encode_summary(d, queries.model_path()), "secret": secret_scan.secret_scan, "near": minhash_dedup.near_duplicates,
    "quality": quality_rules.quality, "exact": exact_dedup.exact_dedup, "score": pitman_yor.scores, "runs": periodic_runs.run_summary,
    "align": lambda d: cross_tokenizer.cross_tokenizer(d, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), queries.model_path()),
    "stock": lambda d: cutting_stock.pack_tokens(d, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")),
    "pack": lambda d: best_fit_packing.pack_documents(d, best_fit_packing.word_count("text"), best_fit_packing.text_cluster("text")),
}
PAGES = {"url": url_filter.url_filter, "html": html_extract.extract}
TEXT = "one two three four five six seven\n" * 12
LONG = "wort " * 60_000
ROWS = [(1, None, None, None, 5), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, LONG, "en", "s", 9), (5, TEXT, "en", "s", 9), (5, TEXT, "en", "s", 9), (6, TEXT, "en", "s", 9), (None, TEXT, None, "s", 1), (None, "a b c", None, "s", 1), (-(1 << 63), "x", "de", "t", 1), ((1 << 63) - 1, "x", "de", "t", 1)]


def documents(spark, clash=True):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'{c}' as `{c}`" for c in CLASH)) if clash else df


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain, clash = (OPERATORS[name](documents(spark, c)) for c in (False, True))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    wanted = [c for c in plain.columns if c not in CLASH]
    rows = [sorted(map(tuple, df.select(*wanted).collect()), key=key) for df in (plain, clash)]
    if name == "score":  # seats depend on nothing but the rows, and sums on their order
        rows = [[r[:5] for r in x] for x in rows]
    assert rows[0] == rows[1]
    assert len({r[0] for r in rows[0]}) == len({r[0] for r in ROWS})
    assert OPERATORS[name](documents(spark).filter("false")).count() == 0


@pytest.mark.parametrize("name", PAGES)
def test_clashing_columns_of_pages(spark, name):
    rows = [(1, "http://a.net/x", "<p>one<p>two"), (2, "http://a.net/y", "<p>one<p>three"), (2, "http://a.net/y", "<p>one<p>three"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.selectExpr("*", *(f"'{c}' as `{c}`" for c in CLASH))
    a, b = (sorted(map(str, PAGES[name](p).collect())) for p in (pages, clash))
    assert a == b and len(a) == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_edge_rows(spark, name, stage):
    docs = documents(spark)
    out = stage(spark, docs, "")
    rows = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and all(r[c] == c for r in rows for c in CLASH)
    assert stage(spark, docs.filter("false"), "").count() == 0
    assert {r.doc_id for r in rows} <= {r[0] for r in ROWS}


def test_shelves_can_be_cleared(spark):
    import os

    shelf = store.Shelf(spark)
    shelf.put(spark.range(3))
    path = shelf.root.removeprefix("file:")
    assert os.path.isdir(path)
    store.clear(spark)
    assert not os.path.exists(path) and not store.SHELVES
