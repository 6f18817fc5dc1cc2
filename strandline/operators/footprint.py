"""Cut signals corrected for sequence bias, position-matrix bias, signals by fragment length.

Sequences come as pieces (chrom, chunk, seq) of one size, see tools.chunked; a region meets only the pieces that it touches. Rows of
regions carry a unique _ord. Signals are rows (_ord, offset, ...), one for each position of a region; sums over neighbours are windows
inside a region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .cuts import pileup
from .tools import sequences


def _positions(regions: DataFrame, margin: int) -> DataFrame:
    """(_ord, offset) for every position of the regions and margin more on either side; offset 0 is a region's first position."""
    size = F.col("final") - F.col("initial")
    return regions.filter(size > 0).select("_ord", F.explode(F.sequence(F.lit(-margin).cast("bigint"), size + (margin - 1))).alias("offset"))


def expected_bias(regions: DataFrame, chunks: DataFrame, size: int, table: DataFrame, margin: int) -> DataFrame:
    """(_ord, offset, forward, reverse): bias of the k-mer around each position, by the table (orientation, kmer, bias).

    A forward k-mer begins k // 2 before the position, or one later if k is odd; a reverse one is the reverse complement of the k-mer
    that begins one position on. K-mers that the table doesn't have, or that the sequence's end cuts, count 1."""
    k = table.agg(F.max(F.length("kmer")).alias("_k"))
    first = k.select("_k", (F.floor(F.col("_k") / 2) - F.col("_k") % 2).alias("_before"))
    wide = regions.crossJoin(first)  # one row
    wide = wide.filter("initial < final").select("_ord", "chrom", (F.col("initial") - margin - F.col("_before")).alias("initial"), (F.col("final") + margin + F.col("_k")).alias("final"), F.lit("+").alias("orientation"), "_k", "_before")
    # Positions before the sequence's start have no letters: the string begins later by as many.
    text = sequences(wide.drop("_k", "_before"), chunks, size).join(wide.select("_ord", "_k", "_before", F.greatest(-F.col("initial"), F.lit(0)).alias("_cut"), (F.col("final") - F.col("initial") - F.col("_k")).alias("_n")), "_ord")
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1 - F.col("_before")))
    each = text.select("_ord", "_k", "_cut", "seq", at.alias("_at")).withColumn("offset", F.col("_at") - margin)
    begin = F.col("_at") - F.col("_cut") + 1

    def kmer(start: Column) -> Column:
        return F.when(start >= 1, F.substr("seq", start.cast("int"), F.col("_k")))

    pair = each.select("_ord", "offset", kmer(begin).alias("_f"), reverse_complement(kmer(begin + 1)).alias("_r"))
    for side, strand, out in (("_f", "+", "forward"), ("_r", "-", "reverse")):
        own = table.filter(F.col("orientation") == strand).select(F.col("kmer").alias(side), F.col("bias").alias(out))
        pair = pair.join(own, side, "left")
    return pair.select("_ord", "offset", F.coalesce("forward", F.lit(1.0)).alias("forward"), F.coalesce("reverse", F.lit(1.0)).alias("reverse"))


def bias_corrected(regions: DataFrame, cuts: DataFrame, chunks: DataFrame, size: int, table: DataFrame, window: int = 50) -> DataFrame:
    """(_ord, offset, signal): for each position of a region and each strand, the log of its cuts plus one over the cuts that its bias
    leads to expect plus one, both strands added. Expected cuts are those of the window around the position (window // 2 before it, the
    rest from it on), times the position's share of the window's bias. A region so near the start of its sequence that a window or its
    k-mers begin at 0 or before keeps its plain number of cuts; k-mers beyond the end count as bias 1.

    cuts: chrom, initial, final, orientation, as cuts.cut_sites gives them."""
    half = window // 2
    before = table.agg(F.floor(F.max(F.length("kmer")) / 2).alias("_b"))
    flagged = regions.crossJoin(before).select("_ord", "chrom", "initial", "final", (F.col("initial") - half - F.col("_b") <= 0).alias("_edge"))  # one row
    wide = flagged.select("_ord", "chrom", (F.col("initial") - half).alias("initial"), (F.col("final") + half).alias("final"))
    count = lambda strand: F.sum(F.when(F.col("orientation") == strand, F.col("n")).otherwise(0))
    piled = pileup(wide, cuts, ("orientation",)).groupBy("_ord", (F.col("offset") - half).alias("offset")).agg(count("+").alias("nf"), count("-").alias("nr"))
    rows = _positions(flagged, half).join(expected_bias(regions, chunks, size, table, half), ["_ord", "offset"], "left").join(piled, ["_ord", "offset"], "left")
    rows = rows.select("_ord", "offset", *(F.coalesce(c, F.lit(1.0)).alias(c) for c in ("forward", "reverse")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nf", "nr")))
    around = Window.partitionBy("_ord").orderBy("offset").rowsBetween(-half, window - half - 1)
    summed = rows.select("*", *(F.sum(c).over(around).alias(f"s_{c}") for c in ("forward", "reverse", "nf", "nr")))

    def score(n: str, bias: str) -> Column:
        return F.log(F.col(n) + 1) - F.log(F.col(f"s_{n}") * (F.col(bias) / F.col(f"s_{bias}")) + 1)

    own = summed.join(flagged.select("_ord", (F.col("final") - F.col("initial")).alias("_n"), "_edge"), "_ord").filter((F.col("offset") >= 0) & (F.col("offset") < F.col("_n")))
    signal = F.when(F.col("_edge"), (F.col("nf") + F.col("nr")).cast("double")).otherwise(score("nf", "forward") + score("nr", "reverse"))
    return own.select("_ord", "offset", signal.alias("signal"))


def position_counts(cuts: DataFrame, sequences: DataFrame, key: str, k: int, most: int = 100) -> DataFrame:
    """(kind, orientation, place, letter, n): letters at each place of the k-mers around cuts (kind observed) and of all k-mers of the
    sequences (kind expected). A k-mer around a cut (key, orientation, position) begins k // 2 before it; those of the minus strand, and
    the expected ones for it, are reverse-complemented. Of the cuts at one place and strand most + 1 count. All five letters A, C, G, T, N
    are counted; the last k-mer of a sequence isn't among the expected."""
    half = k // 2
    places = cuts.groupBy(key, "orientation", "position").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("n"))
    own = places.filter(F.col("position") >= half).join(sequences, key).withColumn("kmer", F.substr("seq", (F.col("position") - half + 1).cast("int"), F.lit(k)))
    oriented = F.when(F.col("orientation") == "-", reverse_complement(F.col("kmer"))).otherwise(F.col("kmer"))
    observed = own.filter(F.length("kmer") == k).select(F.lit("observed").alias("kind"), "orientation", "n", F.posexplode(F.split(oriented, "")).alias("place", "letter"))
    seen = observed.groupBy("kind", "orientation", "place", "letter").agg(F.sum("n").alias("n"))
    # A letter stands at place p of the k-mer that begins p before it; letters are counted before they are dealt to places.
    last = F.length("seq") - k
    letters = sequences.filter(last > 0).select(last.alias("last"), F.posexplode(F.split("seq", "")).alias("at", "letter"))
    inner = (F.col("at") >= k) & (F.col("at") < F.col("last"))
    near = lambda c: F.when(inner, -1).otherwise(F.col(c)).alias(c)  # noqa: E731  (letters far from both ends are one row)
    every = letters.filter(F.col("letter") != "").groupBy("letter", near("at"), near("last")).agg(F.count(F.lit(1)).alias("n"))
    spread = every.select("letter", "n", "at", "last", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"))
    inside = (F.col("at") < 0) | ((F.col("at") - F.col("place") >= 0) & (F.col("at") - F.col("place") < F.col("last")))
    plus = spread.filter(inside).groupBy("place", "letter").agg(F.sum("n").alias("n"))
    minus = plus.select((k - 1 - F.col("place")).alias("place"), F.translate("letter", "ACGT", "TGCA").alias("letter"), "n")
    expected = plus.select(F.lit("expected").alias("kind"), F.lit("+").alias("orientation"), "place", "letter", "n").unionByName(minus.select(F.lit("expected").alias("kind"), F.lit("-").alias("orientation"), "place", "letter", "n"))
    return seen.unionByName(expected)


def position_bias(counts: DataFrame, k: int) -> DataFrame:
    """(orientation, kmer, bias) for all 4 ** k words of A, C, G, T: the product of the observed shares of their letters over that of the
    expected ones, to six digits. Shares are of A, C, G and T at a place; a word with an expected letter that never occurs has no bias."""
    four = counts.filter(F.col("letter").isin(*"ACGT"))
    cells = four.groupBy("orientation", "place", "letter").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind) for kind in ("observed", "expected")))
    total = cells.groupBy("orientation", "place").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e"))
    ratio = cells.join(total, ["orientation", "place"]).select("orientation", "place", "letter", F.try_divide("observed", "o").alias("o"), F.try_divide("expected", "e").alias("e"))
    words = counts.sparkSession.range(4**k).withColumn("kmer", F.concat(*(F.substr(F.lit("ACGT"), (F.floor(F.col("id") / 4 ** (k - 1 - i)) % 4 + 1).cast("int"), F.lit(1)) for i in range(k))))
    each = words.select("kmer", F.posexplode(F.split("kmer", "")).alias("place", "letter")).join(ratio, ["place", "letter"])
    product = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("v")))), F.lit(1.0), lambda a, x: a * x["v"])  # noqa: E731  (k entries)
    per = each.groupBy("orientation", "kmer").agg(product("o").alias("o"), product("e").alias("e"), F.count(F.lit(1)).alias("n"))
    return per.filter((F.col("n") == k) & (F.col("e") > 0)).select("orientation", "kmer", F.round(F.col("o") / F.col("e"), 6).alias("bias"))


def fragment_signals(regions: DataFrame, reads: DataFrame, classes: dict[str, tuple[int | None, int | None]], forward: int, reverse: int) -> DataFrame:
    """(_ord, class, orientation, offset, n): cuts of reads by the length of their fragment (column template, of either sign), all classes
    in one pass. A class is (least, most): with a lower end alone fragments must be longer than it, with both ends they may equal either."""

    def within(low: int | None, high: int | None) -> Column:
        size = F.abs("template")
        if high is None:
            return F.lit(True) if low is None else size > low
        return size <= high if low is None else (size >= low) & (size <= high)

    kinds = F.filter(F.array(*(F.when(within(*ends), F.lit(name)) for name, ends in classes.items())), lambda c: c.isNotNull())
    at = F.when(F.col("orientation") == "-", F.col("final") + reverse - 1).otherwise(F.col("initial") + forward)
    cut = reads.select("chrom", at.alias("initial"), (at + 1).alias("final"), "orientation", F.explode(kinds).alias("class"))
    return pileup(regions, cut, ("class", "orientation"))
