"""Everyday compositions: sequence of regions, profiles, tables by motif, back-splices, alias lookups, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .binned import label_hits, totals
from .islands import merge
from .joins import subtract

PLACE = ("chrom", "initial", "final")


def chunked(genome: DataFrame, size: int) -> DataFrame:
    """(chrom, chunk, seq) of (chrom, seq): sequences in pieces, the form in which they are stored and joined."""
    at = F.sequence(F.lit(0).cast("bigint"), F.floor((F.length("seq") - 1) / size))
    return genome.filter("seq <> ''").select("chrom", F.explode(at).alias("chunk"), "seq").select("chrom", "chunk", F.substring("seq", F.col("chunk").cast("int") * size + 1, F.lit(size)).alias("seq"))


def sequences(regions: DataFrame, chunks: DataFrame, size: int, ex: int = 0, stranded: bool = True) -> DataFrame:
    """(_ord, seq): each region's sequence with ex more on either side, cut at the chromosome's ends, reverse-complemented on the
    minus strand. A region is joined with the pieces it touches alone; one outside every sequence is left out."""
    wide = regions.select("_ord", "chrom", F.greatest(F.col("initial") - ex, F.lit(0)).alias("i"), (F.col("final") + ex).alias("f"), F.col("orientation").alias("_o"))
    touched = wide.filter("i < f").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("i") / size), F.floor((F.col("f") - 1) / size))))
    begin = F.greatest(F.col("i") - F.col("chunk") * size, F.lit(0))
    end = F.least(F.col("f") - F.col("chunk") * size, F.lit(size))
    piece = F.substring("seq", (begin + 1).cast("int"), (end - begin).cast("int"))
    parts = touched.join(chunks, ["chrom", "chunk"]).groupBy("_ord", "_o").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["s"]), "")
    out = F.when((F.col("_o") == "-") & F.lit(stranded), reverse_complement(seq)).otherwise(seq)
    return parts.select("_ord", out.alias("seq")).filter("seq <> ''")


def overlap_profile(a: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """(reference, n): rows of a that overlap each reference, and under else those that overlap none."""
    hits = [totals(a, r, ("_ord",), {"_n": None}).select("_ord").withColumn("reference", F.lit(k)) for k, r in references.items()]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    rest = a.select("_ord").join(every, "_ord", "left_anti").withColumn("reference", F.lit("else"))
    return every.unionByName(rest).groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


def contingency(regions: DataFrame, sites: DataFrame, motif: str) -> DataFrame:
    """(motif, regions_hit, regions_not, genes, sites): by motif the regions with a site and without, the distinct names of the
    former, and the distinct sites inside regions."""
    total = regions.agg(F.count(F.lit(1)).alias("_n"))
    met = totals(sites, regions, (motif, *PLACE), {"_c": None}).groupBy(F.col(motif).alias("label")).agg(F.count(F.lit(1)).alias("sites"))
    per = label_hits(regions, sites, motif, names=True).join(met, "label").withColumnRenamed("label", "motif")
    return per.join(F.broadcast(total)).select("motif", "regions_hit", (F.col("_n") - F.col("regions_hit")).alias("regions_not"), "genes", "sites")  # one row


def back_splices(junctions: DataFrame, within: int = 20_000) -> DataFrame:
    """(chrom, initial, final, name, orientation): junction reads whose donor lies behind its acceptor along the strand. Columns:
    chrom, donor, strand, acceptor_chrom, acceptor, acceptor_strand, kind (below 0 has no motif), donor_start, acceptor_start, name."""
    same = (F.col("chrom") == F.col("acceptor_chrom")) & (F.col("strand") == F.col("acceptor_strand")) & (F.col("kind") >= 0) & (F.abs(F.col("donor") - F.col("acceptor")) < within)
    low = lambda c: F.least(c, f"{c}_start")
    plus, minus = (F.col("strand") == "+") & (low("donor") > low("acceptor")), (F.col("strand") == "-") & (low("acceptor") > low("donor"))
    high = lambda c: F.greatest(c, f"{c}_start")
    rows = junctions.filter(same & (plus | minus))
    return rows.select("chrom", F.when(plus, low("acceptor")).otherwise(low("donor")).alias("initial"), F.when(plus, high("donor")).otherwise(high("acceptor")).alias("final"), "name", F.col("strand").alias("orientation"))


def resolved(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, gene_id): every id a name stands for, letter case aside; null where there is none."""
    look = aliases.select(F.upper("alias").alias("_a"), "gene_id").distinct()
    return names.select("name").join(look, F.upper("name") == F.col("_a"), "left").select("name", "gene_id")


def unmapped(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name): names that stand for no id. A name is looked up, not joined with all its ids."""
    known = aliases.filter("gene_id IS NOT NULL").select(F.upper("alias").alias("_a")).distinct()
    return names.select("name").join(known, F.upper("name") == F.col("_a"), "left_anti")


def annotated(annotation: DataFrame, feature: str, wanted: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Rows of a feature (gene, transcript, exon, ...). wanted: only those of genes that these names (column name) stand for by the aliases
    (alias, gene_id); their name column becomes the wanted one, the first in order where several names mean one gene. Names that differ in
    case alone are one row before they meet the aliases, so an alias of many genes that is wanted many times makes no pairs."""
    rows = annotation.filter(F.col("feature") == feature)
    if wanted is None:
        return rows
    names = wanted.groupBy(F.upper("name").alias("_a")).agg(F.min("name").alias("_wanted"))
    look = aliases.filter("gene_id IS NOT NULL").select(F.upper("alias").alias("_a"), "gene_id")
    ids = look.join(names, "_a").groupBy("gene_id").agg(F.min("_wanted").alias("_wanted"))
    return rows.join(ids, "gene_id").withColumn("name", F.col("_wanted")).drop("_wanted").select(annotation.columns)


def annotation_promoters(annotation: DataFrame, length: int = 1000, tss: int = 0, feature: str = "gene", wanted: DataFrame | None = None, aliases: DataFrame | None = None, by_id: bool = False) -> DataFrame:
    """annotated() rows as promoters: length positions before the first base of each along its strand, that base, and tss more inside.
    Places may begin below 0, as the annotation's arithmetic gives them. by_id: named by gene_id where no names are wanted."""
    plus = F.coalesce(F.col("orientation") == "+", F.lit(False))
    low, high = F.col("initial"), F.col("final")
    rows = annotated(annotation, feature, wanted, aliases).withColumns({"initial": F.when(plus, low - length).otherwise(high - 1 - tss), "final": F.when(plus, low + 1 + tss).otherwise(high - tss + length)})
    return rows.withColumn("name", F.col("gene_id").cast("string")) if by_id and wanted is None else rows


def _any(key: str, test, value: str) -> Column:
    return F.exists(key, lambda c: test(c, value))


def matches(df: DataFrame, want: dict[str, list[str]], how: str = "exact") -> DataFrame:
    """Rows that meet every key by any of its values, letter case aside: exact, inexact (contains) or regex. In an array column any
    entry may match."""
    for key, values in want.items():
        test = {"exact": lambda c, v: F.lower(c) == v.lower(), "inexact": lambda c, v: F.lower(c).contains(v.lower()), "regex": lambda c, v: c.rlike(f"(?i){v}")}[how]
        many = df.schema[key].dataType.typeName() == "array"
        tests = [_any(key, test, v) if many else test(F.col(key), v) for v in values]
        hit = F.lit(False)
        for t in tests:
            hit = hit | F.coalesce(t, F.lit(False))
        df = df.filter(hit)
    return df


def feature_classes(genes: DataFrame, exons: DataFrame, sizes: DataFrame) -> DataFrame:
    """(feature, chrom, initial, final): merged exons, genes less exons, and chromosomes less genes."""
    tag = lambda df, name: df.select(F.lit(name).alias("feature"), *PLACE)
    whole = sizes.select("chrom", F.lit(0).cast("bigint").alias("initial"), F.col("length").alias("final"))
    return tag(merge(exons), "exon").unionByName(tag(subtract(genes, exons), "intron")).unionByName(tag(subtract(whole, genes.select(*PLACE).unionByName(exons.select(*PLACE))), "intergenic"))


def divided(expression: DataFrame, values: list[str], cutoff: float, how: str = "max") -> Column:
    """Whether the max, min or mean of the values lies above the cutoff; nulls don't count."""
    kept = F.filter(F.array(*(F.col(v).cast("double") for v in values)), lambda v: v.isNotNull())
    mean = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(kept), F.lit(0))
    return {"max": F.array_max(kept), "min": F.array_min(kept), "mean": mean}[how] > cutoff


def gtf_line(feature: Column, source: str = "bed") -> Column:
    """A GTF line, starts from 1; a missing name is chrom:initial-final."""
    name = F.coalesce(F.col("name"), F.format_string("%s:%d-%d", "chrom", "initial", "final"))
    return F.format_string(f'%s\t{source}\t%s\t%d\t%d\t.\t%s\t.\tgene_id "%s"; transcript_id "%s";', "chrom", feature, F.col("initial") + 1, "final", F.coalesce("orientation", F.lit(".")), name, name)


def fold_changes(df: DataFrame, x: str, y: str, scale_x: Column, scale_y: Column) -> DataFrame:
    """df with a (mean log2) and m (log2 ratio) of two counts before scaling and after (a_norm, m_norm); zero counts give null."""
    l2 = lambda c: F.log2(F.when(c > 0, c))
    both = {"": (F.col(x), F.col(y)), "_norm": (F.col(x) * scale_x, F.col(y) * scale_y)}
    return df.withColumns({f"{k}{s}": v for s, (a, b) in both.items() for k, v in (("m", l2(a) - l2(b)), ("a", (l2(a) + l2(b)) / 2))})


def by_names(df: DataFrame, wanted: DataFrame, outside: bool = False, score: str | None = None) -> DataFrame:
    """Rows whose name, in any case of letters, is wanted, or isn't (outside; a row without name is). score: a column of wanted (one row for each name) that
    takes the place of the rows' own."""
    names = wanted.groupBy(F.upper("name").alias("_w")).agg(*([F.max(score).alias("_score")] if score else [F.count(F.lit(1)).alias("_score")]))
    if outside:
        return df.join(names, F.upper("name") == F.col("_w"), "left_anti")
    met = df.join(names, F.upper("name") == F.col("_w"))
    return (met.withColumn(score, F.col("_score")) if score else met).drop("_w", "_score")


def gene_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genes of a that b doesn't have; what a repeats stays repeated."""
    return a.join(b.select(F.col("gene").alias("_g")).distinct(), F.col("gene") == F.col("_g"), "left_anti")


def scores(df: DataFrame) -> DataFrame:
    """(chrom, initial, final, score): the data column as a number for each place, null where it is none; the greatest where a place repeats."""
    return df.groupBy("chrom", "initial", "final").agg(F.max(F.expr("try_cast(data AS double)")).alias("score"))


def is_stranded(df: DataFrame) -> DataFrame:
    """(stranded): whether the first row in order of place has a strand; false without rows."""
    first = df.agg(F.min_by("orientation", F.struct("chrom", "initial", "final", "_ord")).alias("o"))
    return first.select(F.coalesce(F.col("o").isin("+", "-"), F.lit(False)).alias("stranded"))


def standard_contigs(df: DataFrame, autosomes: int = 22) -> DataFrame:
    """Rows on chr1 to the last autosome, chrX and chrY."""
    return df.filter(F.col("chrom").isin([f"chr{i}" for i in (*range(1, autosomes + 1), "X", "Y")]))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Contig names with a prefix, where they don't have it."""
    return df.withColumn("chrom", F.when(F.col("chrom").startswith(prefix), F.col("chrom")).otherwise(F.concat(F.lit(prefix), "chrom")))


def tail_counts(genes: DataFrame, reads: DataFrame, inside: int, beyond: int) -> DataFrame:
    """(_ord, n, tails): reads of a gene's strand around its end along the strand, inside before it and beyond after it, and those with a tail (a flag of
    reads). Genes without reads are left out."""
    plus = F.col("orientation") == "+"
    window = genes.withColumns({"initial": F.when(plus, F.col("final") - inside).otherwise(F.col("initial") - beyond), "final": F.when(plus, F.col("final") + beyond).otherwise(F.col("initial") + inside)})
    return totals(window, reads.withColumn("_t", F.when(F.col("tail"), 1).otherwise(0).cast("bigint")), ("_ord",), {"n": None, "tails": "_t"}, ("chrom", "orientation"))


def trim_points(points: DataFrame, sizes: DataFrame, span: int) -> DataFrame:
    """Points (chrom, at) whose span of positions ends inside their chromosome; unknown chromosomes go."""
    return points.join(sizes.select("chrom", "length"), "chrom").filter(F.col("at") + span <= F.col("length")).drop("length")


def combined_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """(chrom, initial, final, sets): the distinct places of all sets, and the sorted names of the sets that have them."""
    parts = [df.select("chrom", "initial", "final", F.lit(n).alias("_set")) for n, df in sets.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("chrom", "initial", "final").agg(F.array_sort(F.collect_set("_set")).alias("sets"))
