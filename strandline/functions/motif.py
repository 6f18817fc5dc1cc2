"""Position weight matrices and their scan over sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_odds(counts: list[list[int]], pseudo: float = 1.0) -> np.ndarray:
    """Counts of A, C, G, T (rows) by position to log2 odds over a flat background."""
    c = np.asarray(counts, dtype=np.float64)
    return np.log2((c + pseudo / 4) / (c.sum(axis=0) + pseudo) / 0.25)


def score_threshold(weights: np.ndarray, fpr: float, background: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), step: float = 1e-3) -> float:
    """The least score that a random sequence reaches with a probability of at most fpr. Scores are rounded to steps, so it may lie off by
    half a step a position; the distribution of their sum is built position by position."""
    grid = np.rint(weights / step).astype(np.int64)
    low, p = 0, np.ones(1)
    for column in grid.T:
        least, most = int(column.min()), int(column.max())
        wider = np.zeros(len(p) + most - least)
        for value, share in zip(column.tolist(), background, strict=True):
            wider[value - least : value - least + len(p)] += share * p
        low, p = low + least, wider
    above = np.cumsum(p[::-1])[::-1]  # the chance of each score or more
    good = np.flatnonzero(above <= fpr)
    return float((low + (good[0] if len(good) else len(p))) * step)


def bounds(weights: np.ndarray) -> tuple[float, float]:
    """The least and the greatest score."""
    return float(weights.min(axis=0).sum()), float(weights.max(axis=0).sum())


def is_palindrome(weights: np.ndarray) -> bool:
    """Whether the matrix is its own reverse complement."""
    return bool(np.allclose(weights, weights[::-1, ::-1]))


def with_normalised(hits: DataFrame, motifs: dict[str, np.ndarray], by_length: bool = False) -> DataFrame:
    """hits with normalised: the score over the motif's length, or its place between the least and greatest score as 0 to 1000."""
    out = F.lit(None).cast("double")
    for name, w in motifs.items():
        low, high = bounds(w)
        value = F.col("score") / w.shape[1] if by_length else (F.col("score") - low) / (high - low) * 1000
        out = F.when(F.col("motif") == name, value).otherwise(out)
    return hits.withColumn("normalised", out)


def best_strand(hits: DataFrame, key: str) -> DataFrame:
    """One hit of a motif at a place: of two strands the higher score, + where they are equal."""
    top = hits.groupBy(key, "motif", "start").agg(F.max(F.struct("score", (F.col("strand") == "+").alias("plus"))).alias("m"))
    return top.select(key, "motif", "start", "m.score", F.when(F.col("m.plus"), "+").otherwise("-").alias("strand"))


def scan(df: DataFrame, key: str, motifs: dict[str, np.ndarray], threshold: float | dict[str, float]) -> DataFrame:
    """(key, motif, strand, start, score) of every offset, either strand, that scores the threshold (one for all, or one for each
    motif) or more. Whole sequences, one matrix row a vector operation; other letters than ACGT score nothing. Hits are gathered over
    sequences, into batches of about a million at most."""
    code = np.full(256, 4, dtype=np.uint8)
    code[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
    limit = threshold if isinstance(threshold, dict) else dict.fromkeys(motifs, threshold)
    tables = [(name, strand, np.vstack([m, np.full(m.shape[1], -np.inf)])) for name, w in motifs.items() for strand, m in (("+", w), ("-", w[::-1, ::-1]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            n = [len(x[2]) for x in found]
            row, table = (np.repeat([x[k] for x in found], n) for k in (0, 1))
            names, strands = (pa.array([t[k] for t in tables]).take(pa.array(table)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names, strands, *(pa.array(np.concatenate([x[k] for x in found])) for k in (2, 3))], names=[key, "motif", "strand", "start", "score"])

        for batch in batches:
            found, size = [], 0
            for i, seq in enumerate(batch.column(1).to_pylist()):
                at = code[np.frombuffer((seq or "").encode("ascii", "replace"), dtype=np.uint8)]
                for t, (name, _, m) in enumerate(tables):
                    n = len(at) - m.shape[1] + 1
                    if n < 1:
                        continue
                    score = np.zeros(n)
                    for j in range(m.shape[1]):
                        score += m[:, j][at[j : j + n]]
                    hit = np.flatnonzero(score >= limit[name])
                    if len(hit):
                        found.append((i, t, hit, score[hit]))
                        size += len(hit)
                if size > 1_000_000:
                    yield flush(batch, found)
                    found, size = [], 0
            if found:
                yield flush(batch, found)

    return df.select(key, "seq").mapInArrow(work, f"{key} bigint, motif string, strand string, start bigint, score double")
