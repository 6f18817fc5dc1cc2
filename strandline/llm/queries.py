"""The thin queries of the operators: production parameters over whole tables, digest columns from the operators' results."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, cross_tokenizer, cutting_stock, exact_dedup, html_extract, line_dedup, minhash_dedup, periodic_runs, pitman_yor, quality_rules, secret_scan, sentencepiece_bpe, url_filter
from .store import table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_removed (lines), text_sha256 and n_chars of the text that is left."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_removed").alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.length(text).cast("bigint").alias("n_chars_left"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_summary(table(spark, sf_dir, "documents", "doc_id", "text"), model_path())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return best_fit_packing.pack_documents(docs, best_fit_packing.word_count(F.col("text")), best_fit_packing.text_cluster(F.col("text")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def tiled_words(doc_id: int | None, words: list) -> list:
    """The words of the query's contract: every tenth document by checksum repeats a stretch of its own from some place on.

    A null doc_id has no checksum: its words stay."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return cross_tokenizer.cross_tokenizer(table(spark, sf_dir, "documents", "doc_id", "text"), files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), model_path())


def op12_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return cutting_stock.pack_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_summary(table(spark, sf_dir, "documents", "doc_id", "text"), tiled_words)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sentencepiece, op3_secret_scan, op4_minhash_dedup, op5_quality_rules, op6_url_filter, op7_best_fit_packing, op8_html_extract, op9_exact_dedup, op10_pitman_yor, op11_cross_tokenizer, op12_cutting_stock, op13_periodic_runs, pipeline)}

#: DuckDB SQL for what SQL can express.
ORACLE_SQL = {
    "op4_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM (SELECT * FROM s SEMI JOIN rare USING (sh)) a JOIN (SELECT * FROM s SEMI JOIN rare USING (sh)) b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, [x for x in string_split_regex(text, '[\x20\x09-\x0D]+') if x <> ''] AS ws, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [n_symbols / greatest(word_chars, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)] AS v FROM m JOIN (SELECT doc_id, lang, source FROM d) USING (doc_id)),
c AS (SELECT lang, source, k, CASE WHEN v[k] > 0 THEN ceil(ln(v[k]) / ln({quality_rules.BASE!r})) END AS cell, count(*) AS n FROM r, range(1, 4) t(k) WHERE NOT base_failed GROUP BY ALL),
g AS (SELECT 2 AS lev, lang, source, k, cell, n FROM c UNION ALL SELECT 1, lang, NULL, k, cell, sum(n) FROM c GROUP BY lang, k, cell UNION ALL SELECT 0, NULL, NULL, k, cell, sum(n) FROM c GROUP BY k, cell),
u AS (SELECT *, CASE WHEN cell IS NULL THEN 0.0 ELSE exp(cell * ln({quality_rules.BASE!r})) * {2 / (1 + quality_rules.BASE)!r} END AS value, sum(n) OVER (s ORDER BY cell NULLS FIRST) AS upto, sum(n) OVER s AS total
  FROM g WINDOW s AS (PARTITION BY lev, lang, source, k)),
q AS (SELECT lev, lang, source, k, max(total) AS n, min(value) FILTER (upto >= {quality_rules.BODY} * total) AS body, min(value) FILTER (upto >= {quality_rules.TAIL} * total) AS tail FROM u GROUP BY ALL),
f AS (SELECT lev, lang, source, k, n, ln(tail + greatest({quality_rules.REACH} * (tail - body), {quality_rules.FLOOR})) AS f FROM q),
h AS (SELECT a.lang, a.source, a.k, (a.n * a.f + {quality_rules.WEIGHT} * (b.n * b.f + {quality_rules.WEIGHT} * e.f) / (b.n + {quality_rules.WEIGHT})) / (a.n + {quality_rules.WEIGHT}) AS f
  FROM f a JOIN f b ON a.lev = 2 AND b.lev = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k JOIN f e ON e.lev = 0 AND e.k = a.k),
o AS (SELECT lang, source, list(exp(f) ORDER BY k) AS f FROM h GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(v[1] <= f[1] AND v[2] <= f[2] AND v[3] <= f[3], true) AS kept
FROM r LEFT JOIN o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
""",
    "op9_exact_dedup": r"""
WITH k AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM k WINDOW g AS (PARTITION BY text_sha256)
""",
    "op13_periodic_runs": r"""
WITH w0 AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
h AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, xor(4294967295::BIGINT, list_reduce(flatten([[4294967295::BIGINT]] || [[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')]),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS h FROM w0),
t AS (SELECT *, n > 0 AND h % 10 = 0 AS tiled, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM h),
w AS (SELECT doc_id, n, CASE WHEN tiled THEN [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END] for i in range(n)] ELSE ws END AS ws FROM t),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w FROM w),
eq AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
isl AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM eq) GROUP BY doc_id, p, g HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, s, len, min(p) AS p FROM isl GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM r GROUP BY doc_id),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / p DESC, s, p) = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s::BIGINT AS start, len::BIGINT AS length, p::BIGINT AS period, (1000 * len // p)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
