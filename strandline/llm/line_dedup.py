"""Line dedup by winnowing over line hashes.

A document is a sequence of line hashes. A gram is the shortest run of lines from a line on that has GRAM words; its hash is made
of its lines' hashes. A window is the shortest run with RUN words from a line on, or back from a line's end. The least gram hash
of a window from a line on is its fingerprint; a window back from an end has that of the window which starts where it does. Equal
windows have equal fingerprints, so positions of fingerprints are joined by their hash first, and only those at two places or more
go on. From such a position the match is extended both ways: over every window around it that has it as its fingerprint, by a hash
of all the window's lines. The first place of a window (by doc_id, text hash, then line) stays, the lines of all others are deleted, and windows
that overlap are one deleted run. A line of a repeated run is in a window of the run, one from that line on or the one back from the
run's end. So the lines of every run of RUN words or more that stands earlier elsewhere are deleted, whatever frequent lines or
shorter passages it holds; the first copy stays. Each place meets the first place of its windows only, so a hot passage costs a row for
each of its windows, not for each pair of places.

Lines are compared with runs of white space as one space and none at the ends. Lines without words match any others like them
but add nothing to a run's words. A document that loses all its words is dropped; rows without text or words stay as they are.
Hot fingerprints and windows are counted in partial steps, then joined, where AQE splits a hot key; no group is collected.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import Shelf, unused
from .words import mix

#: Words that a run must share to be deleted, and words in a gram.
RUN, GRAM = 50, 25


def line_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line."""
    hashes, words = [], []
    for line in data.split(b"\n"):
        w = line.split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(w)))
        words.append(len(w))
    return np.array(hashes, dtype=np.uint64), np.array(words, dtype=np.int64)


def _run_hashes(lines: np.ndarray, base: int):
    """The hash of any runs of lines, given by their starts and ends: polynomial prefix sums."""
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(lines), base, dtype=np.uint64))])
    prefix, acc = np.zeros(len(lines) + 1, dtype=np.uint64), 0
    for i, x in enumerate(lines.tolist()):
        acc = (acc * base + x) & 0xFFFFFFFFFFFFFFFF
        prefix[i + 1] = acc
    return lambda start, end: mix(prefix[end] - prefix[start] * power[end - start])


WINDOW = np.dtype([("low", "<i4"), ("high", "<i4"), ("h1", "<i8"), ("h2", "<i8")])


def fingerprints(hashes: np.ndarray, words: np.ndarray, run: int = RUN, gram: int = GRAM) -> list[tuple[int, np.ndarray]]:
    """(gram hash, windows that have it as their fingerprint) of each line whose gram is one, lines in order."""
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words)])
    gram_end = np.searchsorted(before, before[:n] + gram, side="left")  # lines up to gram_end have the words
    run_end = np.searchsorted(before, before[:n] + run, side="left")
    full = int(np.searchsorted(run_end, n, side="right"))  # windows that the document holds
    if full == 0:
        return []
    spread = mix(hashes)
    one, two = _run_hashes(spread, 0x9E3779B97F4A7C15), _run_hashes(mix(spread + np.uint64(1)), 0xD1342543DE82EF95)
    last = int(np.searchsorted(gram_end, n, side="right"))
    end = gram_end[:last]
    grams = one(np.arange(last), end)
    best, least, value, seen = np.empty(full, dtype=np.int64), deque(), grams.tolist(), 0
    for i, stop in enumerate(np.searchsorted(end, run_end[:full], side="right").tolist()):  # grams i..stop-1 end inside the window
        for j in range(seen, stop):
            while least and value[least[-1]] >= value[j]:  # of equal ones the last
                least.pop()
            least.append(j)
        seen = max(seen, stop)
        while least[0] < i:
            least.popleft()
        best[i] = least[0]
    # Windows back from a line's end: they start as late as they can.
    high = np.arange(int(np.searchsorted(before, run, side="left")), n + 1)
    low = np.searchsorted(before, before[high] - run, side="right") - 1
    other = run_end[low] != high
    low, high = np.concatenate([np.arange(full), low[other]]), np.concatenate([run_end[:full], high[other]])
    out = np.empty(len(low), dtype=WINDOW)
    out["low"], out["high"], out["h1"], out["h2"] = low, high, one(low, high).view(np.int64), two(low, high).view(np.int64)
    order = np.argsort(best[low], kind="stable")
    at, first = np.unique(best[low][order], return_index=True)
    return list(zip(grams[at].view(np.int64).tolist(), np.split(out[order], first[1:]), strict=True))


KEY = "k bigint, tid bigint"
FINGERPRINTS = f"{KEY}, fp bigint, windows binary"
WINDOWS = f"{KEY}, low int, high int, h1 bigint, h2 bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], types: tuple, schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_names(schema))


def _fingerprint_rows(run: int, gram: int):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, tid, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(k, tid, fp, windows.tobytes()) for fp, windows in fingerprints(*line_hashes(data), run, gram)]
            yield _batch(out, types, FINGERPRINTS)

    return work


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, tid, windows = (batch.column(i) for i in range(3))
        data = windows.to_pylist()
        w, n = np.frombuffer(b"".join(data), dtype=WINDOW), [len(x) // WINDOW.itemsize for x in data]
        keys = [np.repeat(c.to_numpy(zero_copy_only=False), n) for c in (k, tid)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*keys, *(w[x] for x in WINDOW.names))], names=_names(WINDOWS))


def _key() -> tuple:
    """The id (null as the smallest) and a hash of the text: rows with the same two are one document."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("bigint")), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def matches(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(k, tid, low, high): windows of a document that stand earlier elsewhere."""
    shelf = Shelf(docs.sparkSession)
    k, tid = _key()
    rows = docs.select(k.alias("k"), tid.alias("tid"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_bytes"))
    found = shelf.put(rows.mapInArrow(_fingerprint_rows(run, gram), FINGERPRINTS))
    again = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("fp").alias("a_fp"), F.xxhash64("fp").alias("a_salt"))
    # The second key makes Spark shuffle both sides for the join, which lets AQE split a hot fingerprint.
    repeated = found.withColumn("salt", F.xxhash64("fp")).join(again, (F.col("fp") == F.col("a_fp")) & (F.col("salt") == F.col("a_salt")))
    windows = shelf.put(repeated.select("k", "tid", "windows").mapInArrow(_window_rows, WINDOWS))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("k", "tid", "low")).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("h1").alias("a_h1"), F.col("h2").alias("a_h2"), F.xxhash64("h1").alias("a_salt"), "a")
    same = (F.col("h1") == F.col("a_h1")) & (F.col("h2") == F.col("a_h2")) & (F.col("salt") == F.col("a_salt"))
    pairs = windows.withColumn("salt", F.xxhash64("h1")).join(first, same)
    return pairs.filter(F.struct("k", "tid", "low") != F.col("a")).select("k", "tid", "low", "high")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds a document's windows to delete; the number of lines that went takes its place."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts, removed = [], []
        for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            n = 0
            if found:
                lines = text.split("\n")
                gone = np.zeros(len(lines), dtype=bool)
                for m in found:
                    gone[m["low"] : m["high"]] = True
                n = int(gone.sum())
                text = "\n".join([x for x, g in zip(lines, gone, strict=True) if not g])
            texts.append(text)
            removed.append(n)
        cols = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64())], names=batch.schema.names)


def line_dedup(docs: DataFrame, run: int = RUN, gram: int = GRAM, removed: str = "_removed") -> DataFrame:
    """docs with later repeated runs cut out of text, and a column with the number of lines cut. No row is dropped.

    A column of docs with that column's name is replaced; all others keep their names and values, whatever they are called."""
    docs = docs.drop(removed)
    name, mk, mt = unused(docs, removed, "match_k", "match_tid")
    found = Shelf(docs.sparkSession).put(matches(docs, run, gram))
    # Windows that overlap or touch are one range, so a document has a row for each run, not for each window.
    w = Window.partitionBy("k", "tid").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("low")).cast("int")).withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = marked.groupBy("k", "tid", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    per = ranges.groupBy(F.col("k").alias(mk), F.col("tid").alias(mt)).agg(F.collect_list(F.struct("low", "high")).alias(name))
    k, tid = _key()
    joined = docs.join(per, (k == F.col(mk)) & (tid == F.col(mt)), "left").select(*(F.col(f"`{c}`") for c in docs.columns), name)
    return joined.mapInArrow(_cut, StructType([*docs.schema.fields, StructField(name, LongType())]))


def line_dedup_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs after line dedup, without the documents that lost all their words."""
    (name,) = unused(docs, "_removed")
    empty = ~F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    return line_dedup(docs, removed=name).filter(~((F.col(name) > 0) & empty)).drop(name)
