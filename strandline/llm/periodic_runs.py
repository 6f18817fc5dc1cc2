"""Periodic runs of words: harmonic grid over periods with longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(6, 4 q) words long, that no
neighbouring word extends keeping period q. For each period p the grid places jp and (j + 1)p of a text are compared: how far the words
from the two on agree (forward) and how far the words before the two agree (backward). Both extensions come from range minima over the
common prefixes of neighbouring suffixes, of the suffix array of the words and of that of the words reversed. A run of period p and
length 4 p or more holds three grid pairs or more in a row, so a pair is asked only where it and the pairs on either side of it have
equal words, and texts without such a pair need no suffix array. A stretch found with several periods has the smallest one: by
length at least 4 p the smallest period divides the others and is found itself.

A word is a run of characters other than 0x20 and 0x09-0x0D; words are compared whole, never by hash. Null text has no words. Texts of
an Arrow batch share one grid and one suffix array; their words never match across texts. Memory grows with the longest text only.
A row stands for itself: repeated rows and ids, null ids and empty texts each give a row. Columns other than the two are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from .store import text_bytes

#: Least length of a run in words and in periods.
LEAST, TIMES = 6, 4
#: Words that share a grid; a longer text has one of its own.
GROUP = 400_000
#: Entries of a block of the range minima.
BLOCK = 16


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; only suffixes that are not alone yet are sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.searchsorted(sorted_words, sorted_words)  # the first place of the group
    k = 1
    while True:
        place = rank[order]
        same = place[1:] == place[:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 2) + after
        new = np.argsort(key, kind="stable")
        order[at] = own[new]
        key = key[new]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        k *= 2


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it; 0 for the first."""
    n = len(words)
    w, before = words.tolist(), np.where(rank > 0, order[rank - 1], -1).tolist()
    out, h = [0] * n, 0
    for i, j in enumerate(before):  # along the text an extension shrinks by one at most
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and w[i + h] == w[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.asarray(out, np.int64)[order]


class RangeMinima:
    """Minima of ranges: a table of doubled spans over blocks, and running minima inside blocks. Memory is linear."""

    def __init__(self, values: np.ndarray):
        self.values = values
        blocks = -(-len(values) // BLOCK)
        grid = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        grid[: len(values)] = values
        grid = grid.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(grid, axis=1).ravel()
        self.rest = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.spans = [grid.min(axis=1)]
        while 2 << (len(self.spans) - 1) <= blocks:
            last, half = self.spans[-1], 1 << (len(self.spans) - 1)
            self.spans.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low .. high], both ends included, low <= high."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.rest[low], self.head[high])
        inside = np.flatnonzero(a == b)
        if len(inside):
            lo, hi = low[inside], high[inside]
            got = self.values[lo]
            for step in range(1, BLOCK):
                got = np.minimum(got, self.values[np.minimum(lo + step, hi)])
            out[inside] = got
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, hi = a[far] + 1, b[far] - 1
            level = np.frexp(hi - lo + 1)[1] - 1
            got = np.empty(len(far), np.int64)
            for k in np.unique(level):
                own = level == k
                got[own] = np.minimum(self.spans[k][lo[own]], self.spans[k][hi[own] + 1 - (1 << k)])
            out[far] = np.minimum(out[far], got)
        return out


class Extensions:
    """Longest common extensions to the right of two places of a sequence, from its suffix array."""

    def __init__(self, words: np.ndarray):
        order = suffix_array(words)
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.minima = RangeMinima(common_prefixes(words, order, self.rank))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.minima.least(np.minimum(x, y) + 1, np.maximum(x, y))


def _candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid pairs that have equal words, as the pairs on either side of them."""
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    places, periods = [], []
    top = int(sizes[0]) // TIMES if len(sizes) and sizes[0] >= LEAST else 0
    fits = np.searchsorted(-sizes, -np.maximum(LEAST, TIMES * np.arange(1, top + 1)), side="right")  # texts long enough for each period
    for p in range(1, top + 1):
        k = int(fits[p - 1])
        pairs = (sizes[:k] - 1) // p
        end = np.cumsum(pairs)
        at = np.arange(end[-1]) * p + np.repeat(starts[:k] - (end - pairs) * p, pairs)
        same = words[at] == words[at + p]
        both = same[1:-1] & same[:-2] & same[2:]
        hit = np.flatnonzero(both) + 1
        if len(hit):
            text = np.searchsorted(end, hit, side="right")
            hit = hit[(hit > (end - pairs)[text]) & (hit < end[text] - 1)]  # not the first or last pair of a text
            places.append(at[hit])
            periods.append(np.full(len(hit), p))
    none = np.empty(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of the texts words[start : start + size] that lie one after the other."""
    at, p = _candidates(words, starts, sizes)
    if not len(at):
        return np.empty((0, 4), np.int64)
    text = np.searchsorted(starts + sizes, at, side="right")
    some = np.unique(text)
    # The texts with candidates alone, each followed by a word of its own.
    moved = np.concatenate([[0], np.cumsum(sizes[some] + 1)])
    own = np.empty(moved[-1], np.int64)
    for n, t in enumerate(some.tolist()):
        own[moved[n] : moved[n + 1] - 1] = words[starts[t] : starts[t] + sizes[t]]
        own[moved[n + 1] - 1] = -1 - n
    n = np.searchsorted(some, text)
    at = at - starts[text] + moved[n]
    last = len(own) - 1
    ahead = Extensions(own).of(at, at + p)
    behind = Extensions(own[::-1].copy()).of(last - at, last - at - p) - 1  # the pair itself is in both
    found = np.stack([n, at - behind - moved[n], behind + p + ahead, p], axis=1)
    found = found[found[:, 2] >= np.maximum(LEAST, TIMES * p)]
    if len(found):
        found = np.unique(found, axis=0)
    new = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)]) if len(found) else np.empty(0, bool)
    found = found[new]  # of equal stretches the smallest period
    found[:, 0] = some[found[:, 0]]
    return found


def _grouped(texts: Iterator[list], most: int) -> Iterator[list[list]]:
    group, n = [], 0
    for words in texts:
        if group and n + len(words) > most:
            yield group
            group, n = [], 0
        group.append(words)
        n += len(words)
    if group:
        yield group


def runs_of(texts: Iterable[list], most: int = GROUP) -> Iterator[tuple[list, list[tuple[int, int, int]]]]:
    """(words, runs) of each text in turn; runs: (start, length, period) by start, then period."""
    for group in _grouped(iter(texts), most):
        number = defaultdict(count().__next__)
        sizes = np.array([len(w) for w in group], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(group)), np.int64, int(sizes.sum()))
        found = runs(ids, starts, sizes)
        ends = np.searchsorted(found[:, 0], np.arange(len(group) + 1))
        for n, words in enumerate(group):
            mine = found[ends[n] : ends[n + 1]]
            yield words, sorted(map(tuple, mine[:, 1:].tolist()), key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words without those that any run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if d == 0]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the first, then that of the smallest period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None


def _mapped(docs: DataFrame, schema: pa.Schema, row: Callable[[list, list], tuple], prepare: Callable | None) -> DataFrame:
    """doc_id and row(words, runs) of each document. prepare(doc_id, words), if given, returns the words to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (data.as_py().split() for data in batch.column(1))
            if prepare is not None:
                texts = map(prepare, batch.column(0).to_pylist(), texts)
            rows = [row(words, found) for words, found in runs_of(texts)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return text_bytes(docs).mapInArrow(run, from_arrow_schema(schema))


def _longs(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.int64()) for n in names]


RUNS = pa.schema([*_longs("doc_id"), pa.field("runs", pa.list_(pa.struct(_longs("start", "length", "period")))), pa.field("text", pa.string())])
SUMMARY = pa.schema([*_longs("doc_id", "n_runs", "start", "length", "period", "exponent_milli"), pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())])


def periodic_runs(docs: DataFrame, prepare: Callable | None = None) -> DataFrame:
    """Per document: doc_id, runs (array of start, length, period by start, then period) and text with its runs collapsed.

    Words of the text are joined by one space."""

    def row(words: list, found: list) -> tuple:
        spans = [{"start": s, "length": n, "period": p} for s, n, p in found]
        return spans, b" ".join(collapsed(words, found)).decode("utf-8", "replace")

    return _mapped(docs, RUNS, row, prepare)


def run_summary(docs: DataFrame, prepare: Callable | None = None) -> DataFrame:
    """Per document: doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without runs), digests of all runs
    and of the collapsed text."""

    def row(words: list, found: list) -> tuple:
        start, length, period = strongest(found) or (None,) * 3
        text = "".join([f"{s},{n},{p}\n" for s, n, p in found])
        left = b" ".join(collapsed(words, found))
        return len(found), start, length, period, length and 1000 * length // period, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left).hexdigest()

    return _mapped(docs, SUMMARY, row, prepare)
