"""Quality rules with thresholds that follow the corpus.

Each document gets a few ratios. Mergeable quantile sketches of every ratio are built per language and source from the documents
that pass the base rules, merged into sketches per language and into one for all. A sketch counts documents in cells of equal
relative width; sketches merge by adding counts, and no random bits or order of rows enter, so a document's verdict is the same in
every run and partitioning.

A fence stands REACH times the distance from the median to the ninth decile above that decile, for every ratio alike; where both are
the same value, it stands FLOOR above. The fence of a language is its own and that of all, weighed by its documents against WEIGHT as
logarithms; the fence of a group is its own and that of its language, weighed in the same way. So a group of few documents follows
its language, one of many itself, and nothing switches at a size; on logarithms, the wide fence of a language whose sources differ
pulls a group's own up little. A document over its fence in any ratio, or failing a base rule, is rejected.

Duplicate lines are counted but have no fence: their words stand in repeated windows, so repeat_ratio judges them already.

DataFrame functions only. The sketches are aggregated in partial steps, so a hot source is a row for each task; the fences are
one row per group, joined by AQE's choice. Where no document passes the base rules there is no fence, and none is kept. Null language
or source is a group of its own; null text counts as empty. Columns of the input keep their names and values, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Shelf

RATIOS = ("symbol_ratio", "repeat_ratio", "mean_word_chars")
#: Quantiles that a fence is read from, its distance in multiples of theirs, and the least distance.
BODY, TAIL, REACH, FLOOR = 0.5, 0.9, 10.0, 0.02
#: Documents of the group above that a group's own are weighed against.
WEIGHT = 200
#: Greatest relative error of a quantile, and the ratio of a sketch's neighbouring cells that gives it.
ERROR = 0.0005
BASE = (1 + ERROR) / (1 - ERROR)
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Low bits of a packed window that hold its place; the rest are of its hash.
PLACE = 24


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text.

    Where the hashes of the windows are all distinct there are none. Else they are packed as hash bits over their place and sorted
    as plain longs; neighbours with equal hash bits are candidates.
    The candidates alone are sorted again by their words, so no hash decides. Then from each place that is left, in order, up to
    three words are counted before the next place begins."""

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def hashes(w: Column) -> Column:
        pair = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 2), F.slice(w, F.lit(2), F.size(w) - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pair, F.slice(w, F.lit(3), F.size(w) - 2), lambda h, c: F.xxhash64(h, c))

    def packed(hs: Column) -> Column:
        high = F.lit(-(1 << PLACE)).cast("bigint")
        return F.sort_array(F.transform(hs, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))

    def candidates(s: Column) -> Column:
        top = lambda x: F.shiftright(x, PLACE)
        again = F.filter(s, lambda x, i: (top(x) == top(F.get(s, i - 1))) | (top(x) == top(F.get(s, i + 1))))
        return F.transform(again, lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))

    def exact(w: Column, at: Column) -> Column:
        return F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    none = F.lit(0).cast("bigint")

    def from_hashes(hs: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(hs) - 1)
        at = F.when(F.size(hs) < 1 << PLACE, let(packed(hs), candidates)).otherwise(every)  # a longer text has all as candidates
        found = let(at, lambda c: F.when(F.size(c) == 0, none).otherwise(let(exact(words, c), lambda s: let(places(s), covered))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(found)

    return F.when(F.size(words) < 4, none).otherwise(let(hashes(words), from_hashes))


def measures(text: Column) -> Column:
    """A struct of n_symbols, n_dup_lines and, in w, n_words, word_chars and n_repeat_words.

    A word is a run of characters other than 0x20 and 0x09-0x0D."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return F.struct(let(words, of_words).alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), dup.alias("n_dup_lines"))


def failed(m: Column) -> Column:
    """The base rules."""
    w = m["w"]
    return (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])


def _ratios(m: Column) -> dict[str, Column]:
    w, one = m["w"], F.lit(1)
    return {
        "symbol_ratio": m["n_symbols"] / F.greatest(w["word_chars"], one),
        "repeat_ratio": w["n_repeat_words"] / F.greatest(w["n_words"], one),
        "mean_word_chars": w["word_chars"] / F.greatest(w["n_words"], one),
    }


def _sketch(value: Column) -> Column:
    """Cell of a value in the sketch: value lies in (BASE ** (cell - 1), BASE ** cell]; null for zero."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(BASE))))


def _cell_value(cell: Column) -> Column:
    """The value that stands for a cell, within ERROR of all its values."""
    return F.when(cell.isNull(), F.lit(0.0)).otherwise(F.exp(cell * F.lit(math.log(BASE))) * (2 / (1 + BASE)))


def _fences_of(cells: DataFrame, *group: str) -> DataFrame:
    """(group, n, a fence for each ratio) from sketches, rows (group, ratio, cell, n). Sketches merge by adding n of equal cells.

    A quantile is the first cell up to which that share of the documents lies. Zero is the lowest cell."""
    key = [F.col(c) for c in group]
    merged = cells.groupBy(*key, "ratio", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key, "ratio")  # a row for each cell of a sketch, whatever the number of documents
    ranked = merged.select("*", F.sum("n").over(w.orderBy(F.col("cell").asc_nulls_first())).alias("upto"), F.sum("n").over(w).alias("total"))
    at = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), _cell_value(F.col("cell")))).alias(n) for n, q in (("body", BODY), ("tail", TAIL))]
    fence = F.col("tail") + F.greatest(REACH * (F.col("tail") - F.col("body")), F.lit(FLOOR))
    per = ranked.groupBy(*key, "ratio").agg(F.max("total").alias("n"), *at)
    return per.groupBy(*key).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("ratio") == i, fence)).alias(r) for i, r in enumerate(RATIOS)))


def fences(measured: DataFrame) -> DataFrame:
    """(f_lang, f_source, a fence for each ratio) of the groups that have documents which pass the base rules; none where none does."""
    values = F.array(*(F.struct(F.lit(i).alias("ratio"), _sketch(c.cast("double")).alias("cell")) for i, c in enumerate(_ratios(F.col("m")).values())))
    rows = measured.filter(~failed(F.col("m"))).select("lang", "source", F.inline(values))
    cells = rows.groupBy("lang", "source", "ratio", "cell").agg(F.count(F.lit(1)).alias("n"))
    per, lang, every = _fences_of(cells, "lang", "source"), _fences_of(cells, "lang"), _fences_of(cells)

    def weighed(n: str, own: Column, above: Column) -> Column:
        return F.exp((F.col(n) * F.log(own) + WEIGHT * F.log(above)) / (F.col(n) + WEIGHT))

    every = every.select(*(F.col(r).alias(f"e_{r}") for r in RATIOS))  # one row: the join with it is of a row for each language
    langs = lang.crossJoin(every).select(F.col("lang").alias("l_lang"), *(weighed("n", F.col(r), F.col(f"e_{r}")).alias(f"l_{r}") for r in RATIOS))
    both = per.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
    return both.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(weighed("n", F.col(r), F.col(f"l_{r}")).alias(f"f_{r}") for r in RATIOS))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """(row: a struct of the kept columns of docs, m, base_failed, kept). A missing lang or source counts as null.

    The measures are written once and read twice, for the fences and for the verdict."""
    part = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    measured = Shelf(docs.sparkSession).put(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), measures(F.col("text")).alias("m"), *part))
    within = F.lit(True)
    for n, c in _ratios(F.col("m")).items():
        within &= c <= F.col(f"f_{n}")
    # A row for each group, each with a few doubles: the smaller side at any corpus size; AQE sees its true size.
    out = measured.join(fences(measured), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return out.select("row", "m", failed(F.col("m")).alias("base_failed"), (~failed(F.col("m")) & F.coalesce(within, F.lit(True))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, "doc_id").select("row.doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.n_dup_lines", "m.w.n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The kept rows with the columns of docs."""
    return judged(docs, *docs.columns).filter("kept").select("row.*")
