"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct 5-word shingles. Sketch: in each round every shingle is thrown into a random bin with a random
value, rounds after the first T have a bin of their own, and a coordinate keeps the least (round, value) that it met. So after 2T
rounds at most every coordinate is filled, whatever the set's size, and matches of coordinates concentrate about the Jaccard
similarity as those of T independent samples. Bands of coordinates give bucket keys; a pair at similarity 0.75 misses every one of
the 32 bands of four with probability (1 - 0.75^4)^32 = 5e-6.

Equal sets are one class first, so copies cost nothing. In a bucket each class is paired with the bucket's least class (a star, no
more rows than members), pairs are verified on the full sets, and links join components. A leader has then met its whole bucket.
Members of buckets that still hold more than one component go through an exact prefix filter on their shingles, which pairs only
documents of different components. So every pair that shares a bucket is tested, shown to be no link, or lies in one component
already; a group of near copies is never paired with itself.
Components grow by least-label steps in Spark tables; nothing is collected.

Null, empty and word-free texts have an empty set and are alone. Rows with the same doc_id count as one document if their sets
are equal, else each links by its own set and the id joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Shelf, text_bytes, unused
from .words import Hashes, mix, shingles

COORDINATES, BANDS = 128, 32
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
_BIN_BITS = COORDINATES.bit_length() - 1
_ROUND_BITS = _BIN_BITS + 1
_LOW = np.uint64((1 << (64 - _BIN_BITS - _ROUND_BITS)) - 1)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """T coordinates of a set of 64-bit items; the set isn't empty."""
    out, open_, at = np.zeros(t, dtype=np.uint64), np.ones(t, dtype=bool), 0
    while at < 2 * t and open_.any():
        # As many rounds at once as fill most bins; rounds later than needed can't change a filled coordinate.
        some = min(max(1, 6 * t // len(items)), 2 * t - at)
        rounds = np.arange(at, at + some, dtype=np.uint64)
        h = mix(items[None, :] ^ _SEEDS[at : at + some, None])
        bins = h >> np.uint64(64 - _BIN_BITS)
        late = rounds >= t
        bins[late] = (rounds[late] - np.uint64(t))[:, None]
        key = np.sort(((bins << np.uint64(64 - _BIN_BITS)) | (rounds[:, None] << np.uint64(64 - _BIN_BITS - _ROUND_BITS)) | (h & _LOW)).ravel())
        b = (key >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        new = first[open_[b[first]]]
        out[b[new]] = key[new]
        open_[b[new]] = False
        at += some
    return out


def bands(coordinates: np.ndarray, n: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of consecutive coordinates."""
    rows = coordinates.reshape(n, -1)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h


def set_of(data: bytes, cache: Hashes) -> np.ndarray:
    return shingles(cache.of(data.lower().split()))


SKETCHES = "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in batches:
        n, a, b, keys = [], [], [], []
        for data in batch.column(1).to_pylist():
            s = set_of(data, cache)
            n.append(len(s))
            # Two sums of mixed items name the set.
            a.append(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64) if len(s) else 0)
            b.append(np.add.reduce(mix(s + np.uint64(0x14057B7EF767814F)), dtype=np.uint64).astype(np.int64) if len(s) else 0)
            keys.append(bands(sketch(s)).astype(np.int64) if len(s) else np.empty(0, dtype=np.int64))
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64))
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n", "set_a", "set_b", "bands"])


PAIRS = "a bigint, b bigint"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to the pairs that are links. Rows come sorted by b, so its set is made once."""
    cache, last, other = Hashes(), None, None
    for batch in batches:
        a, b = batch.column(0), batch.column(1).to_pylist()
        keep = []
        texts, others = batch.column(2), batch.column(3)
        for i, key in enumerate(b):
            if key != last:
                last, other = key, set_of(others[i].as_py(), cache)
            own = set_of(texts[i].as_py(), cache)
            both = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(own) + len(other) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def components(nodes: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, comp) for nodes (id) and links (a, b): least id reachable. Every node links to the least label around it, and labels
    jump to their label's label, so the number of steps grows with the logarithm of a chain."""
    edges = shelf.put(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = shelf.put(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        seen = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("to")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, F.col("id") == F.col("to"), "left").select("id", F.least("comp", "near").alias("mid"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("j_id"), F.col("comp").alias("j_comp"))
        after = shelf.put(step.join(jump, F.col("mid") == F.col("j_id"), "left").select("id", F.least("mid", "j_comp").alias("comp"), "was"))
        done = after.filter("comp <> was").limit(1).count() == 0
        shelf.drop(labels)
        labels = after.select("id", "comp")
        labels._shelf_path = after._shelf_path
        if done:
            break
    return nodes.join(labels.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"), "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _compatible(n, m):
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _by_key(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Join on a bucket key. A second key, made of the first, has Spark shuffle both sides, so AQE can split a hot bucket."""
    left, right = left.withColumn("_s", F.xxhash64(key)), right.withColumn("_t", F.xxhash64(other))
    return left.join(right, (F.col(key) == F.col(other)) & (F.col("_s") == F.col("_t"))).drop("_s", "_t", other)


def _shared(buckets: DataFrame) -> DataFrame:
    """Buckets (key, id, n) with two members or more, each row with the bucket's least member."""
    lead = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("l_key"), "lead")
    return _by_key(buckets, lead, "key", "l_key")


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, n, comp) of the members, leaders left out, of buckets that hold more than one component without their leader."""
    label = comps.select(F.col("id").alias("c_id"), "comp")
    left = members.filter(F.col("id") != F.col("lead.id")).select("key", "id", "n").join(label, F.col("id") == F.col("c_id")).drop("c_id")
    mixed = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select(F.col("key").alias("m_key"))
    return _by_key(left, mixed, "key", "m_key").select("id", "n", "comp").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in batches:
        sets = [set_of(data, cache).astype(np.int64) for data in batch.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(np.concatenate(sets) if sets else np.empty(0, dtype=np.int64))], names=["id", "n", "comp", "sh"])


def _rest(open_: DataFrame, texts: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b) of documents in different components that can be links, by an exact prefix filter.

    Shingles of a document are ordered from rare to common. A link needs 6/7 of the smaller set and 3/4 of the larger one in
    common, so the first seventh of the smaller and the first quarter of the larger share a shingle. Shingles that only one
    document has come first and join with nothing, so documents that share no more than a common passage don't meet."""
    rows = open_.join(texts.select(F.col("id").alias("t_id"), "text"), F.col("id") == F.col("t_id")).select("id", "n", "comp", "text")
    rows = shelf.put(rows.mapInArrow(_shingle_rows, "id bigint, n bigint, comp bigint, sh bigint"))
    common = rows.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumnRenamed("sh", "c_sh")
    own = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "sh")) - 1
    ranked = shelf.put(_by_key(rows, common, "sh", "c_sh").withColumn("place", place).filter(F.col("place") <= F.floor(F.col("n") / 4)).drop("c"))
    small = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 6 / 7)).select(*(F.col(c).alias(f"s_{c}") for c in ("sh", "id", "n", "comp", "place")))
    larger = (F.col("s_n") < F.col("n")) | (F.col("s_n") == F.col("n")) & (F.col("s_id") < F.col("id"))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("s_n") - F.col("s_place")) - 1
    reach = most * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("s_n"))
    ranked, small = ranked.withColumn("_s", F.xxhash64("sh")), small.withColumn("_t", F.xxhash64("s_sh"))
    met = ranked.join(small, (F.col("sh") == F.col("s_sh")) & (F.col("_s") == F.col("_t")) & larger & (F.col("comp") != F.col("s_comp")) & _compatible(F.col("n"), F.col("s_n")) & reach)
    return met.select(*_pair(F.col("id"), F.col("s_id")))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b) of every member with its bucket's leader, where sizes allow a link."""
    return members.filter((F.col("id") != F.col("lead.id")) & _compatible(F.col("n"), F.col("lead.n"))).select(*_pair(F.col("id"), F.col("lead.id")))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets."""
    one = texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    both = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b")).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify, PAIRS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(text_bytes(docs).mapInArrow(_sketch_rows, SKETCHES))
    classes = shelf.put(rows.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    buckets = classes.filter("id is not null").select("id", "n", F.explode("bands").alias("key"))
    members = shelf.put(_shared(buckets))
    nodes = members.select("id").distinct()
    wanted = nodes.withColumnRenamed("id", "w")
    texts = shelf.put(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).filter("id is not null and text is not null").join(wanted, F.col("id") == F.col("w"), "left_semi"))
    pairs = shelf.put(_stars(members).distinct())
    links = shelf.put(_linked(pairs, texts))
    comps = shelf.put(components(nodes, links, shelf))
    open_ = shelf.put(_unsettled(members, comps))
    if not open_.isEmpty():
        more = shelf.put(_rest(open_, texts, shelf).distinct().join(pairs, ["a", "b"], "left_anti"))
        found = shelf.put(_linked(more, texts))
        if not found.isEmpty():
            comps = shelf.put(components(nodes, links.union(found), shelf))
    label = comps.select(F.col("id").alias("c_id"), "comp")
    by_set = classes.join(label, F.col("id") == F.col("c_id"), "left").select(F.col("set_a").alias("s_a"), F.col("set_b").alias("s_b"), F.coalesce("comp", "id").alias("comp"))
    found = rows.drop("bands").join(by_set, (F.col("set_a") == F.col("s_a")) & (F.col("set_b") == F.col("s_b")) & (F.col("n") > 0), "left")
    comp = F.coalesce("comp", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def near_dedup_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each group of near duplicates, all its rows if its id repeats. Columns of docs may
    have any names."""
    (name,) = unused(docs, "kept_id")
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
