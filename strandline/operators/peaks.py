"""Differential peaks and footprints: scaling factors, dispersion, conditional tests, re-split tests, peaks from decoded states."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..lineage import written
from . import binned
from .islands import merge, with_islands
from .joins import overlap_join, semi
from .placement import hashed
from .stats import corrected


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """df with _rank from 1 inside keys by order. bucket must not fall as order rises; a task ranks one bucket, and what crosses
    buckets is their row counts."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c")).select(*keys, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return rows.join(base, [*keys, "_bucket"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside)).drop("_bucket", "_base")


def quantile_normalised(df: DataFrame, sample: str, key: str, value: str, width: float) -> DataFrame:
    """df with each sample's values replaced by the mean of the values of equal rank over samples; ties rank by key. width: size of
    a value bucket, see ranked."""
    rows = ranked(df, [sample], [value, key], F.floor(F.col(value) / width))
    mean = rows.groupBy("_rank").agg(F.avg(value).alias("_mean"))
    return rows.join(mean, "_rank").withColumn(value, F.col("_mean")).drop("_rank", "_mean")


def tmm(df: DataFrame, samples: list[str], top: int = 10_000, keep_m: float = 80, keep_a: float = 95) -> DataFrame:
    """(sample, factor) by trimmed means of log ratios against the mean sample, over the top bins by total.

    df: (sample, chrom, bin, value), zero bins may be missing. Logs are natural although the factor is a power of 2, as published
    pipelines do. If the trimming leaves nothing, nothing is trimmed; without usable bins the factor is 1."""
    ref = df.groupBy("chrom", "bin").agg((F.sum("value") / len(samples)).alias("ref")).filter("ref > 0")
    parts = []
    for name in samples:
        own = df.filter(F.col("sample") == name).select("chrom", "bin", "value")
        best = ref.join(own, ["chrom", "bin"], "left").fillna(0, ["value"]).orderBy(F.desc(F.col("value") + F.col("ref")), "chrom", "bin").limit(top).filter("value > 0")
        ma = best.select(F.log(F.col("ref") / F.col("value")).alias("m"), (F.log(F.col("ref") * F.col("value")) / 2).alias("a"))
        cut = lambda c, k: [F.percentile(c, 1 - k / 100).alias(f"{c}_low"), F.percentile(c, k / 100).alias(f"{c}_high")]
        inside = F.col("m").between(F.col("m_low"), F.col("m_high")) & F.col("a").between(F.col("a_low"), F.col("a_high"))
        rows = ma.join(F.broadcast(ma.agg(*cut("m", keep_m), *cut("a", keep_a))))  # one row against at most top rows
        mean = lambda w: F.sum(F.when(w, F.col("m") * F.col("a"))) / F.nullif(F.sum(F.when(w, F.col("a"))), F.lit(0.0))
        parts.append(rows.agg(F.coalesce(F.pow(F.lit(2.0), F.coalesce(mean(inside), mean(F.lit(True)))), F.lit(1.0)).alias("factor")).select(F.lit(name).alias("sample"), "factor"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_variance(df: DataFrame, cut: float = 99.75) -> DataFrame:
    """(a): least-squares dispersion of v = a m^2 + m over bins (m, v) of replicates, bins above either percentile left out, 0 at
    least. All bins are used; percentiles are exact over the distinct values."""
    high = df.agg(F.percentile("m", cut / 100).alias("_m"), F.percentile("v", cut / 100).alias("_v"))
    kept = df.join(F.broadcast(high)).filter("m < _m AND v < _v")  # one row
    m2 = F.col("m") * F.col("m")
    return kept.agg(F.greatest(F.coalesce(F.sum((F.col("v") - F.col("m")) * m2) / F.nullif(F.sum(m2 * m2), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("a"))


def conditional_p(x: int, y: int, alpha: float) -> float:
    """-log10 of the chance that of x + y counts the first sample has x or fewer, both negative binomial of one dispersion and
    mean; the mean cancels. Of the splits the lower half is summed, and its tail counts half."""
    n, r = x + y, 1 / max(alpha, 1e-9)
    i = np.arange(1, n + 1, dtype=float)
    g = np.concatenate([[0.0], np.cumsum(np.log((i - 1 + r) / i))])
    both = (g + g[::-1])[: n // 2 + 1]
    weight = np.exp(both - both.max())
    tail = weight[: min(x, n // 2) + 1].sum()
    return -math.log10(tail / (2 * weight.sum())) if tail > 0 else 324.0


def with_conditional_p(df: DataFrame, gain: Column, x: str, y: str, alpha: float) -> DataFrame:
    """df with p, -log10: a gain is tested for few counts in y, a loss for few in x. A batch tests each distinct pair once, so the
    rows, which may come from a long plan, are read once and not joined with themselves."""

    @F.pandas_udf(DoubleType())
    def test(low: pd.Series, high: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": low, "b": high})
        each = pairs.drop_duplicates()
        each = each.assign(p=[conditional_p(int(a), int(b), alpha) for a, b in zip(each["a"], each["b"], strict=True)])
        return pairs.merge(each, on=["a", "b"], how="left")["p"].astype(float)

    low, high = F.when(gain, F.col(y)).otherwise(F.col(x)), F.when(gain, F.col(x)).otherwise(F.col(y))
    return df.withColumn("p", test(low.cast("bigint"), high.cast("bigint")))


def peaks(states: DataFrame, size: int, alpha: float, keep: float = 0.7) -> DataFrame:
    """(chrom, initial, final, orientation, n, x, y, p): bins (chrom, bin, state, x, y) of state 1 (+) and 2 (-), those whose p lies
    above the keep percentile, merged where neighbours of a direction touch; counts are added and tested again."""
    plus = F.col("state") == 1
    bins = with_conditional_p(states.filter("state IN (1, 2)"), plus, "x", "y", alpha)
    bins = bins.join(F.broadcast(bins.agg(F.percentile("p", keep).alias("_cut")))).filter("p > _cut")  # one row
    rows = bins.select("chrom", F.when(plus, "+").otherwise("-").alias("orientation"), (F.col("bin") * size).alias("initial"), (F.col("bin") * size + size).alias("final"), "x", "y")
    runs = with_islands(rows, 1, ("chrom", "orientation")).groupBy("chrom", "orientation", "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).drop("_island")
    return with_conditional_p(runs, F.col("orientation") == "+", "x", "y", alpha)


def merge_peaks(df: DataFrame, ext: int) -> DataFrame:
    """(chrom, orientation, initial, final, n, x, y, p): peaks of a direction closer than ext joined, counts added, the greatest p."""
    return with_islands(df, ext, ("chrom", "orientation")).groupBy("chrom", "orientation", "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("p").alias("p")).drop("_island")


def footprints(found: DataFrame, regions: DataFrame, reads: DataFrame, smallest: int, ext: int, around: int) -> DataFrame:
    """(chrom, initial, final, tags): found intervals that overlap a region, merged, short ones widened by ext and merged again;
    tags counts reads around the middle."""
    first = merge(semi(found, regions)).select("chrom", "initial", "final")
    short = F.col("final") - F.col("initial") < smallest
    wide = first.select("chrom", F.when(short, F.greatest(F.col("initial") - ext, F.lit(0))).otherwise(F.col("initial")).alias("initial"), F.when(short, F.col("final") + ext).otherwise(F.col("final")).alias("final"))
    out = merge(wide).select("chrom", "initial", "final")
    mid = F.floor((F.col("initial") + F.col("final")) / 2)
    window = out.select("chrom", F.col("initial").alias("i"), F.col("final").alias("f"), F.greatest(mid - around, F.lit(0)).alias("initial"), (mid + around).alias("final"))
    n = overlap_join(window, reads.select("chrom", "initial", "final")).groupBy("chrom", F.col("i").alias("initial"), F.col("f").alias("final")).agg(F.count(F.lit(1)).alias("tags"))
    return out.join(n, ["chrom", "initial", "final"], "left").fillna(0, ["tags"])


def resplit(a: DataFrame, b: DataFrame, repeats: int, size: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sets (unique _ord in each) thrown together and split anew, size rows to the left, in each repeat; chrom becomes
    rep:chrom. The split is by hash rank, so a seed gives the same one on any partitioning."""
    rows = a.select("chrom", "initial", "final", F.lit(0).alias("_set"), "_ord").unionByName(b.select("chrom", "initial", "final", F.lit(1).alias("_set"), "_ord"))
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_h", hashed(*(F.col(c).cast("string") for c in ("rep", "_set", "_ord")), F.lit(str(seed))))
    parts = written(ranked(each, ["rep"], ["_h", "_set", "_ord"], F.shiftright("_h", 36)).withColumn("chrom", F.concat_ws(":", "rep", "chrom")))
    pick = lambda w: parts.filter(w).select("rep", "chrom", "initial", "final")
    return pick(F.col("_rank") <= size), pick(F.col("_rank") > size)


def three_counts(a: DataFrame, b: DataFrame, rep: Column) -> DataFrame:
    """(rep, a_only, b_only, both) of the merged sides, rep taken from chrom. Both sides are merged once and meet once: an island of a side
    counts alone where no piece in common names it."""
    place = ["chrom", "initial", "final"]
    m, n = (written(merge(x).select(*place)) for x in (a, b))
    met = written(overlap_join(m, n))
    tag = lambda df, k: df.select(rep.alias("rep"), F.lit(k).alias("k"))
    alone = lambda side, names: side.join(met.select(*(F.col(x).alias(c) for x, c in zip(names, place, strict=True))).distinct(), place, "left_anti")
    rows = tag(alone(m, place), 0).union(tag(alone(n, [f"b_{c}" for c in place]), 1)).union(tag(met, 2))
    return rows.groupBy("rep").agg(*(F.count_if(F.col("k") == k).alias(c) for k, c in enumerate(("a_only", "b_only", "both"))))


def resplit_test(a: DataFrame, b: DataFrame, repeats: int, size: int) -> DataFrame:
    """(a_only, b_only, both, mean_both, chi2, p): the observed three counts against their means over random re-splits, chi-square
    of a 2 by 3 table, whose tail at two degrees of freedom is an exponential. Null where a column is empty on both sides."""
    names = ("a_only", "b_only", "both")
    seen = three_counts(a, b, F.lit("0")).drop("rep")
    left, right = resplit(a, b, repeats, size)
    mean = three_counts(left, right, F.substring_index("chrom", ":", 1)).agg(*((F.sum(c) / repeats).alias(f"m_{c}") for c in names))
    both = seen.join(mean)  # one row each
    o, e = (sum((F.col(f"{k}{c}") for c in names), F.lit(0.0)) for k in ("", "m_"))
    terms = []
    for c in names:
        col = F.col(c) + F.col(f"m_{c}")
        for seen_c, total in ((F.col(c), o), (F.col(f"m_{c}"), e)):
            want = F.nullif(col * total / (o + e), F.lit(0.0))
            terms.append((seen_c - want) * (seen_c - want) / want)
    chi = sum(terms[1:], terms[0])
    return both.select(*names, F.col("m_both").alias("mean_both"), chi.alias("chi2"), F.exp(-chi / 2).alias("p"))


def activity_change(df: DataFrame, key: str) -> DataFrame:
    """df (key, ps_1, ps_2, tc_1, tc_2) with activity, z and p: scores of both conditions brought to 0..1 by their joint range, the
    sum of the two changes, standardised over the keys; p is the two-sided normal tail. Without spread z is 0."""
    span = lambda c: (F.least(F.min(f"{c}_1"), F.min(f"{c}_2")).alias(f"_{c}"), F.nullif(F.greatest(F.max(f"{c}_1"), F.max(f"{c}_2")) - F.least(F.min(f"{c}_1"), F.min(f"{c}_2")), F.lit(0.0)).alias(f"_{c}w"))
    rows = df.join(F.broadcast(df.agg(*span("ps"), *span("tc"))))  # one row
    change = lambda c: (F.col(f"{c}_2") - F.col(f"{c}_1")) / F.coalesce(F.col(f"_{c}w"), F.lit(1.0))
    rows = rows.withColumn("activity", change("ps") + change("tc")).drop("_ps", "_psw", "_tc", "_tcw")
    rows = rows.join(F.broadcast(rows.agg(F.avg("activity").alias("_m"), F.nullif(F.stddev_pop("activity"), F.lit(0.0)).alias("_s"))))
    rows = rows.withColumn("z", F.coalesce((F.col("activity") - F.col("_m")) / F.col("_s"), F.lit(0.0))).drop("_m", "_s")

    @F.pandas_udf(DoubleType())
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    return rows.withColumn("p", two_sided("z"))


def filter_strand_lag(df: DataFrame, cut: float, most: float = 2.0) -> DataFrame:
    """df (plus, minus, p) with q and z: rows with a corrected p of at most cut whose log ratio of strands lies less than most standard
    deviations from the mean of all rows. A strand without reads has no ratio, so the row goes."""
    rows = corrected(df, "p").drop("rejected").withColumn("_r", F.log(F.nullif(F.col("plus"), F.lit(0)) / F.nullif(F.col("minus"), F.lit(0))))
    spread = rows.agg(F.avg("_r").alias("_m"), F.nullif(F.stddev_pop("_r"), F.lit(0.0)).alias("_s"))
    rows = rows.crossJoin(spread).withColumn("z", F.coalesce((F.col("_r") - F.col("_m")) / F.col("_s"), F.when(F.col("_r").isNotNull(), 0.0)))  # one row
    return rows.filter((F.col("q") <= cut) & (F.abs("z") < most)).drop("_r", "_m", "_s")


def split_by_fold(df: DataFrame, fold: float, gap: int) -> DataFrame:
    """(chrom, kind, initial, final, n): peaks (plus, minus) at least fold apart, as gain or lose, those of a kind closer than gap joined."""
    kind = F.when(F.col("plus") >= fold * F.col("minus"), "gain").when(F.col("minus") >= fold * F.col("plus"), "lose")
    rows = df.withColumn("kind", kind).filter("kind IS NOT NULL")
    return with_islands(rows, gap, ("chrom", "kind")).groupBy("chrom", "kind", "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.count(F.lit(1)).alias("n")).drop("_island")


def _rank_rule(x: Column, y: Column) -> Column:
    """The smaller of two p after their ranks, as -log10: the smaller p doubled or the larger one, whichever is smaller."""
    return F.greatest(F.greatest(x, y) - F.log10(F.lit(2.0)), F.least(x, y))


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_rank_rule on numbers; a missing p leaves the other."""
    return np.fmax(np.fmax(x, y) - np.log10(2.0), np.fmin(x, y))


def combined(a: DataFrame, b: DataFrame, stranded: bool = False) -> DataFrame:
    """(chrom, orientation, initial, final, name, p): every pair of overlapping peaks (unique _ord, name, p as -log10), of one strand only if
    stranded, at the place of the left one with the p of the rank rule. In order of place, pairs that follow one another on one strand and
    overlap are joined to their hull: it keeps the first name, and its p and each next one are combined anew.

    All pairs of a left peak stand in the bin that it begins in, where hulls are made and folded. Only hulls at the bin's
    start, within the longest peak's length, and its last one may go on in another bin: they leave it with their p in order and are folded
    once they are joined."""
    site = ("_ord", "chrom", "initial", "final", "orientation", "name", "p")
    most = binned.longest(a)
    width = max(1 << 13, most)

    def kernel(lo: int, r: pa.Table, s: pa.Table) -> pa.Table:
        r, s = r.sort_by([(c, "ascending") for c in ("initial", "final", "_ord")]), s.sort_by("initial")
        (a_i, a_f), (b_i, b_f) = binned.ends(r), binned.ends(s)
        strand = binned.encoded(pa.chunked_array([*r["orientation"].chunks, *s["orientation"].chunks], pa.string()))[0]
        strand, other = strand[: len(r)], strand[len(r) :]
        rank = np.argsort(np.argsort(s["_ord"].to_numpy()))
        x, y = (c["p"].to_numpy().astype(float) for c in (r, s))
        of, with_, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for which, at in binned.stretches(np.searchsorted(np.maximum.accumulate(b_f), a_i, "right"), np.searchsorted(b_i, a_f, "left")) if len(r) and len(s) else ():
            hit = b_f[at] > a_i[which]
            if stranded:
                hit &= (strand[which] == other[at]) & (strand[which] >= 0)
            which, at = which[hit], at[hit]
            order = np.argsort(which * len(s) + rank[at])
            which, at = which[order], at[order]
            of.append(which)
            with_.append(at)
            p.append(_fold(x[which], y[at]))
        of, with_, p = (np.concatenate(c) for c in (of, with_, p))
        rows, first = np.unique(of, return_index=True)  # left peaks with a pair, and their first ones
        o, i, f = strand[rows], a_i[rows], a_f[rows]
        turn = np.ones(len(rows), bool)
        turn[1:] = o[1:] != o[:-1]
        base, step = (i[0], f.max() - i[0] + 2) if len(rows) else (0, 1)
        run = np.cumsum(turn) * step
        top = np.maximum.accumulate(run + f - base)
        turn[1:] |= (run + i - base)[1:] >= top[:-1]
        begin = np.flatnonzero(turn)
        n = len(begin)
        last, start = np.append(begin[1:], len(rows))[:n] - 1, first[begin]
        size = np.diff(np.append(start, len(of)))
        # Peaks of earlier bins end before lo + most, so hulls of the bin's first run that begin there may be one with theirs, and with each other.
        seq = np.where((np.cumsum(np.append([True], o[1:] != o[:-1]))[begin] == 1) & (i[begin] < lo + most), 0, -1) if n else begin
        seq[-1:] = np.maximum(seq[-1:], 0) + (seq[-1:] < 0)
        whole = np.flatnonzero(seq < 0)
        whole = whole[np.argsort(-size[whole], kind="stable")]  # the longest first
        folded = p[start] if n else p
        for k in range(1, size[whole[0]] if len(whole) else 0):
            on = whole[: np.searchsorted(-size[whole], -k, "left")]
            folded[on] = _fold(folded[on], p[start[on] + k])
        keep = np.where(seq >= 0, size, 1)
        offsets = np.concatenate([[0], np.cumsum(keep)])
        at = np.repeat(start - offsets[:-1], keep) + np.arange(offsets[-1])
        values = np.where(np.repeat(seq < 0, keep), np.repeat(folded, keep), p[at])
        lead, mate = pa.array(rows[begin]), pa.array(with_[start])
        own = {c: r[c].take(lead) for c in ("chrom", "orientation", "initial")}
        return pa.table({
            **own, "final": pa.array(top[last] - run[begin] + base), "lo": pa.array(np.full(n, lo)), "k": pa.array(np.arange(n)), "seq": pa.array(seq), "name": r["name"].take(lead), "b_name": s["name"].take(mate),
            "ps": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, from_pandas=True)),
        })

    schema = "chrom string, orientation string, initial bigint, final bigint, lo bigint, k bigint, seq bigint, name string, b_name string, ps array<double>"
    hulls = written(binned.meet(binned.at_start(a.select(*site), width), binned.dealt_for(b.select(*site), most, width), kernel, schema, width=width))
    name = lambda x, y: F.concat_ws(":", x, y).alias("name")
    done = hulls.filter("seq < 0").select("chrom", "orientation", "initial", "final", name("name", "b_name"), F.get("ps", F.lit(0)).alias("p"))
    along = Window.partitionBy("chrom").orderBy("lo", "k")
    turn = (F.col("seq") == 1) | ~F.lag("orientation").over(along).eqNullSafe(F.col("orientation"))
    runs = hulls.filter("seq >= 0").withColumn("_turn", F.when(turn, 1).otherwise(0)).withColumn("_run", F.sum("_turn").over(along))
    inside = Window.partitionBy("chrom", "_run").orderBy("lo", "k")
    before = F.max("final").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(before.isNull() | (F.col("initial") >= before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(inside))
    joined = marked.groupBy("chrom", "orientation", "_run", "_island").agg(F.min("initial").alias("initial"), F.max("final").alias("final"), F.array_sort(F.collect_list(F.struct("lo", "k", "name", "b_name", "ps"))).alias("all"))
    ps = joined.withColumn("ps", F.flatten(F.transform("all", lambda s: s["ps"]))).withColumn("head", F.get("all", F.lit(0)))
    p = F.aggregate(F.slice("ps", 2, F.greatest(F.size("ps") - 1, F.lit(0))), F.get("ps", F.lit(0)), _rank_rule)
    return done.unionByName(ps.select("chrom", "orientation", "initial", "final", name(F.col("head.name"), F.col("head.b_name")), p.alias("p")))


def negative_binomial_parameters(mean: Column, alpha: Column) -> tuple[Column, Column]:
    """Mean and dispersion to the number of successes and their probability."""
    return 1 / alpha, 1 / (1 + mean * alpha)
