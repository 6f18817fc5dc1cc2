"""Exact duplicates by a minimal perfect hash over the digests of earlier documents.

The corpus is taken in two steps of arrival, the earlier ids as history. History's distinct digests are dealt into shards; each
shard builds a minimal perfect hash (levels of collision-free positions, ranked) whose slots hold the whole digest and the
winner. The digests that arrive later, grouped first so that a hot text is one row for each task, look their slot up and
compare all 32 bytes: equal ones are repeats of the winner, the others form groups of their own.

Null and empty texts are the same text. A null doc_id loses to any other and is kept only where all ids of its group are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shelf
from .words import mix

#: Distinct digests in a shard: a task holds one shard.
SHARD = 50_000
#: Positions for each key on a level.
GAMMA = 2.0
WHITE = r"[\x20\x09-\x0D]+"


def _key(digests: np.ndarray, level: int) -> np.ndarray:
    """64-bit hash of 32-byte digests (an array of four words each) on a level."""
    h = np.full(len(digests), level + 1, dtype=np.uint64)
    for i in range(4):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + digests[:, i])
    return h


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: n keys to slots 0..n-1."""

    def __init__(self, digests: np.ndarray):
        left, self.levels = digests, []
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            at = _key(left, len(self.levels)) % np.uint64(size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append(bits)
            left = left[~bits[at.astype(np.int64)]]
        self.before = np.concatenate([[0], np.cumsum([b.sum() for b in self.levels])]).astype(np.int64)
        self.ranks = [np.cumsum(b) - 1 for b in self.levels]

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 where it surely isn't a key. The caller compares the slot's digest."""
        out, open_ = np.full(len(digests), -1, dtype=np.int64), np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_key(digests[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 4)


SIDE = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
OUT = "digest binary, keep_id bigint, group_size bigint"


def _resolve(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
    """One shard: build the hash over old digests, look the new ones up, return every group of the shard."""
    new = new.rename_columns([c.removeprefix("new_") for c in new.column_names])
    old, new = (t.select(SIDE.names) if t.num_rows else SIDE.empty_table() for t in (old, new))  # a side without rows comes without columns
    known, fresh = _words(old["digest"]), _words(new["digest"])
    table = PerfectHash(known)
    slot = table.slots(known)
    owner = np.empty(len(known), dtype=np.int64)
    owner[slot] = np.arange(len(known))
    found = table.slots(fresh)
    at = owner[np.maximum(found, 0)] if len(known) else np.zeros(len(fresh), dtype=np.int64)
    same = (found >= 0) & (known[at] == fresh).all(axis=1) if len(known) else np.zeros(len(fresh), dtype=bool)
    size = old["n"].to_numpy().astype(np.int64).copy()
    np.add.at(size, at[same], new["n"].to_numpy()[same])
    alone = new.filter(pa.array(~same))
    return pa.table(
        {
            "digest": pa.concat_arrays([old["digest"].combine_chunks(), alone["digest"].combine_chunks()]),
            "keep_id": pa.concat_arrays([old["keep_id"].combine_chunks(), alone["keep_id"].combine_chunks()]),
            "group_size": pa.concat_arrays([pa.array(size), alone["n"].combine_chunks()]),
        }
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the normalised text."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def groups(keyed: DataFrame, pivot: int | None, shard: int = SHARD) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct digest; ids up to pivot (and null ones) are history."""
    count = keyed.count()
    shards = max(1, -(-count // shard))
    old = F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(pivot))

    def side(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        return per.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    known, fresh = side(keyed.filter(old)), side(keyed.filter(~old))
    fresh = fresh.select(*(F.col(c).alias(f"new_{c}") for c in fresh.columns))
    return known.groupBy("shard").cogroup(fresh.groupBy("new_shard")).applyInArrow(_resolve, OUT)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text)."""
    shelf = Shelf(docs.sparkSession)
    keyed = shelf.put(digests(docs))
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    pivot = None if low is None else (low + high) // 2
    found = groups(keyed, pivot).withColumnRenamed("digest", "_digest")
    joined = keyed.join(found, F.col("digest") == F.col("_digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
