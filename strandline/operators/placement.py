"""Random placement of regions in the free space of chromosomes, by hashes, so a seed gives the same places on any partitioning."""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written
from . import binned
from .islands import BLOCK
from .joins import complement, outside, overlap_join, semi


def running(df: DataFrame, keys: list[str], at: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """df with out, the sum of value over the rows before it in its keys, by at (distinct inside keys); scanned in blocks."""
    rows = df.withColumn("_block", F.floor(F.col(at) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_s")).select(*keys, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*keys, "_block"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_block", "_base")


def free_space(sizes: DataFrame, exclude: DataFrame) -> DataFrame:
    """(chrom, initial, final, offset): gaps of the chromosomes (chrom, length) outside exclude, laid end to end."""
    gaps = complement(exclude, sizes).withColumn("_n", F.col("final") - F.col("initial"))
    inside = running(gaps, ["chrom"], "initial", "_n", "_in")
    chroms = gaps.groupBy("chrom").agg(F.sum("_n").alias("_c"))
    base = chroms.select("chrom", F.coalesce(F.sum("_c").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each chromosome
    return inside.join(base, "chrom").select("chrom", "initial", "final", (F.col("_base") + F.col("_in")).alias("offset"))


def hashed(*parts: Column) -> Column:
    """48 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("bigint")


def place(df: DataFrame, sizes: DataFrame, exclude: DataFrame, repeats: int, tries: int = 20, seed: int = 1) -> DataFrame:
    """(rep, _ord, chrom, initial, final): rows of df (unique _ord) at random places of the free space, so chromosomes are chosen by their
    free positions; placements may overlap one another. Of so many tries the first that fits into its gap counts; a row that none fits has
    null places."""
    rows = df.select("_ord", "initial", "final").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return _drawn(rows, free_space(sizes, exclude), tries, str(seed))


def _drawn(rows: DataFrame, space: DataFrame, tries: int, seed: str) -> DataFrame:
    """(rep, _ord, chrom, initial, final) for rows (rep, _ord, initial, final)."""
    total = space.agg(F.sum(F.col("final") - F.col("initial")).alias("total"))
    size = F.col("final") - F.col("initial")
    rows = rows.select("rep", "_ord", size.alias("size"))
    drawn = rows.crossJoin(total).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(tries))))  # one row
    at = hashed(F.col("rep").cast("string"), F.col("_ord").cast("string"), F.col("k").cast("string"), F.lit(seed)) % F.col("total")
    points = drawn.select("rep", "_ord", "size", "k", F.lit("free").alias("chrom"), at.alias("initial")).withColumn("final", F.col("initial") + 1)
    laid = space.select(F.lit("free").alias("chrom"), F.col("offset").alias("initial"), (F.col("offset") + F.col("final") - F.col("initial")).alias("final"), F.col("chrom").alias("c"), F.col("initial").alias("i"), F.col("final").alias("f"))
    start = F.col("b_i") + F.col("initial") - F.col("b_initial")
    fits = overlap_join(points, laid).filter(start + F.col("size") <= F.col("b_f"))
    first = fits.groupBy("rep", "_ord").agg(F.min(F.struct("k", F.col("b_c").alias("chrom"), start.alias("initial"), (start + F.col("size")).alias("final"))).alias("m"))
    return rows.select("rep", "_ord").join(first, ["rep", "_ord"], "left").select("rep", "_ord", "m.chrom", "m.initial", "m.final")


def place_apart(df: DataFrame, sizes: DataFrame, exclude: DataFrame, repeats: int = 1, tries: int = 20, seed: int = 1, rounds: int = 60) -> DataFrame:
    """(rep, _ord, chrom, initial, final): as place(), but no two placements of a repeat overlap.

    In every round the rows without a place draw one each. A draw that overlaps a place given before is void; of draws that overlap
    one another one stays if no other that it overlaps has a smaller hash, and the rest draw again. The draw with the smallest hash always
    stays, so rounds go on until every row has a place; a row that was void in all of so many rounds has null places: no room was
    found for it. Everything is a function of rep, _ord, round and seed, so partitioning changes nothing.

    A round is one shuffle: draws and places given before meet in bins, a draw in its own bin with all draws that it may overlap and all places that
    those may. The free pieces go to every task, as three numbers each."""
    keys, spark = ["rep", "_ord"], df.sparkSession
    pieces = free_space(sizes, exclude).orderBy("offset").toArrow()
    offset, begin, end = (pieces[c].to_numpy() for c in ("offset", "initial", "final"))
    chroms = pieces["chrom"].combine_chunks().dictionary_encode() if len(pieces) else pa.array([], pa.string()).dictionary_encode()
    name_of, names = chroms.indices.to_numpy(), np.array([*chroms.dictionary.to_pylist(), None], dtype=object)
    total = int((end - begin).sum())
    laid = [array("q", c.tolist()) for c in (offset, begin, end)]  # plain numbers: a draw looks up one piece at a time
    most = binned.longest(df)
    width = max(binned.WIDTH, most)
    tasks = spark.sparkContext.defaultParallelism
    rows = df.select(F.col("_ord").cast("bigint").alias("_ord"), (F.col("final") - F.col("initial")).cast("bigint").alias("size")).repartition(tasks, "_ord").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    empty = {"name": "string", "initial": "bigint", "final": "bigint"}
    state = written(rows.select(*keys, "size", *(F.lit(None).cast(k).alias(c) for c, k in empty.items())))
    columns = [*keys, "size", *empty]
    schema = "rep int, _ord bigint, size bigint, name string, initial bigint, final bigint"

    def draw(n: int):
        def of(batches):
            number = lambda text: int.from_bytes(hashlib.md5(text.encode()).digest()[:6], "big")
            offset, begin, end = laid
            for batch in batches:
                rep, ids, size, given = (batch.column(c).to_pylist() for c in (*keys, "size", "initial"))
                at, rank = np.full((len(ids), 2), -1, np.int64), np.full(len(ids), -1, np.int64)
                for j, (r, o, long, place) in enumerate(zip(rep, ids, size, given, strict=True)):
                    if place is not None or long is None:
                        continue
                    rank[j] = number(f"{r}:{o}:{seed}:{n}:rank")
                    for k in range(1, tries + 1 if total else 0):
                        x = number(f"{r}:{o}:{k}:{seed}:{n}") % total
                        g = bisect_right(offset, x) - 1
                        start = begin[g] + x - offset[g]
                        if start + long <= end[g]:
                            at[j] = g, start
                            break
                new = at[:, 0] >= 0
                name = np.where(new, names[np.where(new, name_of[at[:, 0]] if len(name_of) else -1, -1)], np.asarray(batch.column("name").to_pylist(), dtype=object))
                old = [np.asarray(pc.fill_null(batch.column(c), -1)) for c in ("initial", "final", "size")]
                i, f = np.where(new, at[:, 1], old[0]), np.where(new, at[:, 1] + old[2], old[1])
                none = i < 0
                yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "_ord": batch.column("_ord"), "size": batch.column("size"), "name": pa.array(name, pa.string()), "initial": pa.array(i, mask=none), "final": pa.array(f, mask=none), "rank": pa.array(rank)})

        return of

    def settle(t: pa.Table) -> pa.Table:
        """The bin's own rows, draws that are void or lost without a place."""
        own, fresh = t["own"].to_numpy(zero_copy_only=False), t["rank"].to_numpy() >= 0
        keep = np.ones(len(t), bool)
        if t["initial"].null_count < len(t):
            (i, f), rank, ids = binned.ends(t), t["rank"].to_numpy(), t["_ord"].to_numpy()
            new = np.flatnonzero(fresh)
            new = new[np.argsort(i[new], kind="stable")]
            void = binned.tally(np.iinfo(np.int64).min, (i[new], f[new]), (i[~fresh], f[~fresh]), [np.ones((~fresh).sum(), np.int64)])[0] > 0
            keep[new[void]] = False
            live = new[~void]
            mine = live[own[live]]
            lost = np.zeros(len(mine), bool)
            for which, at in binned.stretches(np.searchsorted(np.maximum.accumulate(f[live]), i[mine], "right"), np.searchsorted(i[live], f[mine], "left")) if len(mine) else ():
                x, y = mine[which], live[at]
                beats = (f[y] > i[x]) & ((rank[y] < rank[x]) | ((rank[y] == rank[x]) & (ids[y] < ids[x])))
                lost[which[beats]] = True
            keep[mine[lost]] = False
        rest = pa.array(~keep)
        t = pa.table({**{c: t[c] for c in (*keys, "size")}, **{c: pc.if_else(rest, pa.scalar(None, t[c].type), t[c]) for c in empty}, "own": t["own"]})
        return t.filter(t["own"]).drop_columns("own")

    for n in range(rounds):
        drawn = state.mapInArrow(draw(n), schema + ", rank bigint")
        reach = F.when(F.col("rank") < 0, 2 * most).otherwise(most)  # places given before, and draws
        near = F.sequence(F.floor((F.col("initial") - reach) / width), F.floor((F.col("initial") + reach) / width))
        alone = F.array(F.pmod(F.xxhash64("_ord"), F.lit(4 * tasks)))  # rows without a draw go along
        each = drawn.withColumn("_bin", F.explode(F.when(F.col("initial").isNull(), alone).otherwise(near)))
        each = each.withColumn("own", F.col("initial").isNull() | (F.floor(F.col("initial") / width) == F.col("_bin")))
        state = written(each.groupBy("rep", "name", "_bin").applyInArrow(settle, schema))
        if state.filter("initial IS NULL").isEmpty():
            break
    return state.select(*keys, F.col("name").alias("chrom"), "initial", "final")


def close_windows(regions: DataFrame, background: DataFrame, least: int = 200, length: int = 100, seed: int = 1) -> DataFrame:
    """(_ord, chrom, initial, final, fits): for each row of background that overlaps a region one window of so many positions inside it,
    at least so far from every region: one of the free pieces longer than the window, all alike, and a start in it, both by md5. Where no
    piece is long enough the window lies around the middle of the longest one, and fits is false; a row without free positions has none.

    _ord is that of background. Pieces are pre-aggregated to the one with the smallest hash, so a row with many pieces is no hot spot."""
    own = semi(background, regions.select("chrom", "initial", "final"))
    wide = regions.select("chrom", F.greatest(F.col("initial") - least, F.lit(0)).alias("initial"), (F.col("final") + least).alias("final"))
    pieces = outside(own, wide, "_ord").withColumn("n", F.col("final") - F.col("initial"))
    text = lambda c: F.col(c).cast("string")
    rank = hashed(text("_ord"), text("initial"), F.lit(str(seed)))
    long_enough = F.col("n") > length
    best = F.min(F.when(long_enough, F.struct(rank.alias("rank"), "initial", "n")))
    longest = F.max(F.struct("n", (-F.col("initial")).alias("at"), "final"))
    per = pieces.groupBy("_ord", "chrom").agg(best.alias("p"), longest.alias("q"))
    start = F.col("p.initial") + hashed(text("_ord"), F.lit("start"), F.lit(str(seed))) % (F.col("p.n") - length)
    middle = F.floor((F.col("q.final") - F.col("q.at")) / 2)
    fits = F.col("p").isNotNull()
    return per.select("_ord", "chrom", F.when(fits, start).otherwise(middle - length // 2).alias("initial"), F.when(fits, start + length).otherwise(middle + length // 2).alias("final"), fits.alias("fits"))
