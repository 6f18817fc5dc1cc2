"""Best-fit packing of documents into sequences under conflict constraints.

Documents are dealt by a hash of their id, length, source and cluster into shards of bounded size, so a hot source is spread evenly,
and so are documents with a null or repeated id unless they are equal in all of these. In a shard, pieces are
placed from the largest: a bin with the least room that holds the piece is found in an order of residuals, and the search goes on
to the next larger residual while the bin conflicts. A bin conflicts if it already holds a document of the same duplicate cluster,
or as many documents of the source as allowed; bins carry both as bitmaps. Where none is left a new bin opens. A document longer
than a bin gives full bins of its own and one rest, so no word is dropped. Pieces are placed by (length, doc_id, piece, source, cluster), so the
result doesn't depend on the order of rows; ties in residual go to the bin opened first.

Lengths are counted in words. A document without words takes no place and has one piece of length 0 and bin -1. Null source or
cluster conflicts with nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Bits that a source has in a bin: documents of one source in a bin at most.
PER_SOURCE = 4
#: Documents dealt to a shard on average.
SHARD = 4000
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, shard int, bin int, offset bigint"


def pack(items: list[tuple[int, int, int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int, int]]:
    """items: (doc_id, piece, length, source, cluster), lengths up to capacity, ids unique. Returns (item, bin, offset) by item."""
    tie = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(range(len(items)), key=lambda i: (-items[i][2], items[i][0], items[i][1], tie(items[i][3]), tie(items[i][4])))
    often = Counter(x[4] for x in items if x[4] is not None)
    clusters = {c: 1 << n for n, c in enumerate(sorted(c for c, k in often.items() if k > 1))}
    sources: dict[object, int] = {}
    one = (1 << per_source) - 1
    room: list[tuple[int, int]] = []  # (residual, bin), sorted
    holds_cluster, holds_source, out = [], [], []
    for i in order:
        _, _, size, source, cluster = items[i]
        bit = clusters.get(cluster, 0)
        shift = None if source is None else sources.setdefault(source, len(sources)) * per_source
        at = bisect_left(room, (size, -1))
        while at < len(room):
            b = room[at][1]
            if not holds_cluster[b] & bit and (shift is None or holds_source[b] >> shift & one != one):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(holds_cluster)
            holds_cluster.append(0)
            holds_source.append(0)
        holds_cluster[b] |= bit
        if shift is not None:
            used = holds_source[b] >> shift & one
            holds_source[b] |= (used + 1) << shift  # the bits of a source fill from the lowest
        if left > size:
            insort(room, (left - size, b))
        out.append((i, b, capacity - left))
    return out


def pack_documents(docs: DataFrame, length, cluster=None, source="source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, start and length (words), shard, bin (number in its shard), offset (words).

    length, cluster: columns of docs. doc_id is unique; a null one is packed like any other."""
    shards = max(1, -(-docs.count() // shard))
    rows = docs.select(
        "doc_id",
        length.cast("bigint").alias("n"),
        (F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")).alias("source"),
        (F.lit(None).cast("bigint") if cluster is None else cluster).alias("cluster"),
    )
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "source", "cluster"), F.lit(shards)).cast("int"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        items, starts, out = [], [], []
        for doc, n, source, cluster in zip(*(t[c].to_pylist() for c in ("doc_id", "n", "source", "cluster")), strict=True):
            if n == 0:
                out.append((doc, 0, 0, 0, -1, 0))
            for piece in range(-(-n // capacity)):
                items.append((doc, piece, min(capacity, n - piece * capacity), source, cluster))
                starts.append(piece * capacity)
        known = [(x[0] if x[0] is not None else -(1 << 63), *x[1:]) for x in items]
        out += [(items[i][0], items[i][1], starts[i], items[i][2], b, o) for i, b, o in pack(known, capacity, per_source)]
        ids, pieces, begins, sizes, bins, offsets = zip(*out, strict=True)
        return pa.table([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(bins, pa.int32()), pa.array(offsets, pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("shard").applyInArrow(run, SCHEMA)


def word_count(text) :
    """Words of a text (runs of characters other than 0x20 and 0x09-0x0D); null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def text_cluster(text):
    """Cluster of texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))))
