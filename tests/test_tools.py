"""Annotation sources by small files; everyday tools by hand-made cases."""

from pyspark.sql import functions as F

from strandline.operators import tools
from strandline.sources import annotation
from test_intervals import df


def _file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_sizes_and_aliases(spark, tmp_path):
    p = _file(tmp_path, "sizes", "chr1\t100\nchrX\t50\nchr1_random\t5\nchrM\t9\nbad\n")
    assert sorted(r.chrom for r in annotation.read_sizes(spark, p, m=False).collect()) == ["chr1", "chrX"]
    p = _file(tmp_path, "alias", "ENSG1\tTp53\tp53&LFS1\nENSG2\tGap\n")
    aliases = annotation.read_aliases(spark, p)
    assert sorted((r.gene_id, r.alias) for r in aliases.collect()) == [("ENSG1", "ENSG1"), ("ENSG1", "LFS1"), ("ENSG1", "P53"), ("ENSG1", "TP53"), ("ENSG2", "ENSG2"), ("ENSG2", "GAP")]
    names = spark.createDataFrame([("p53",), ("none",)], "name string")
    assert {(r.name, r.gene_id) for r in tools.resolved(names, aliases).collect()} == {("p53", "ENSG1"), ("none", None)}


def test_expression(spark, tmp_path):
    p = _file(tmp_path, "e", "gene value\nENSG1.7 2.5\ngap.1 3\n")
    assert sorted(tuple(r) for r in annotation.read_expression(spark, p).collect()) == [("ENSG1", 2.5), ("GAP.1", 3.0)]


def test_motifs(spark, tmp_path):
    p = _file(tmp_path, "m.mtf", "T1\tM1\t0\tAhr+Arnt\tbHLH\tP1;P2\tlab\tvertebrates\tMus musculus\t1.5,2\nT2\tM2\t0\tGap\n")
    rows = annotation.read_motif_metadata(spark, p)
    first = rows.filter("name = 'M1'").first()
    assert first.gene_names == ["Ahr", "Arnt"] and first.thresholds == [1.5, 2.0] and rows.filter("name = 'M2'").first().species is None
    assert [r.name for r in tools.matches(rows, {"gene_names": ["arnt"], "tax_group": ["VERTEBRATES"]}).collect()] == ["M1"]
    assert tools.matches(rows, {"name": ["^m\\d$"]}, "regex").count() == 2 and tools.matches(rows, {"species": ["x"]}).count() == 0
    _file(tmp_path, "box.pwm", "1 2\n3 4\n5 6\n7 8\n")
    m = annotation.read_matrices(spark, str(tmp_path)).first()
    assert m.name == "box" and m.counts == [[1, 2], [3, 4], [5, 6], [7, 8]]


def test_triplexes(spark, tmp_path):
    line = "r\t1\t9\tchr2:100-200\t5\t15\t7\t0.1\te\tR\t+\tP\t0.5\n"
    p = _file(tmp_path, "t", "# head\n" + line + line.replace("chr2:100-200", "chrM") + "short\t1\n")
    r = annotation.read_triplexes(spark, p, 2).collect()
    assert [(x.rna_i, x.rna_f, x.chrom, x.initial, x.final, x.motif) for x in r] == [(3, 11, "chr2", 105, 115, "R")]


def test_experiments(spark, tmp_path):
    p = _file(tmp_path, "x", "# c\nBASE_DIR /data\nname type file cell\nA regions a.bed T,B\nB genes /b.txt ALL\nC regions c.bed B\nno\n")
    rows = annotation.read_experiments(spark, p)
    assert sorted((r.name, r.file, r.value) for r in rows.collect()) == [("A", "/data/a.bed", "B"), ("A", "/data/a.bed", "T"), ("B", "/b.txt", "ALL"), ("C", "/data/c.bed", "B")]
    full = annotation.expand_all(rows)
    assert sorted(r.value for r in full.filter("name = 'B'").collect()) == ["B", "T"]
    assert sorted((r.value, r.reference, r["query"]) for r in annotation.paired(full, "genes", "regions").collect()) == [("B", "B", "A"), ("B", "B", "C"), ("T", "B", "A")]


def test_wig_and_narrow_peaks(spark, tmp_path):
    bins = spark.createDataFrame([("c1", 50, 2), ("c1", 0, 1), ("c2", 0, 0)], "chrom string, initial long, value long")
    annotation.write_wig(bins, str(tmp_path / "w"), 50)
    assert [r.value for r in spark.read.text(str(tmp_path / "w" / "of=c1")).collect()] == ["variableStep chrom=c1 span=50", "1 1", "51 2"]
    peaks = spark.createDataFrame([("c", 0, 10, "+", 9, 4, 3.25)], "chrom string, initial long, final long, orientation string, x long, y long, p double")
    annotation.write_narrow_peaks(peaks, str(tmp_path / "n"))
    cells = spark.read.text(str(tmp_path / "n")).first().value.split("\t")
    assert len(cells) == 10 and cells[4:8] == ["33", "+", "2.0", "3.25"]


def test_sequences_across_chunks(spark):
    genome = spark.createDataFrame([("c1", "ACGTACGTTT"), ("c2", "")], "chrom string, seq string")
    regions = df(spark, [(1, 8), (8, 20), (50, 60)]).withColumn("orientation", F.when(F.col("_ord") == 0, "-").otherwise("+"))
    got = {r["_ord"]: r.seq for r in tools.sequences(regions, tools.chunked(genome, 3), 3).collect()}
    assert got == {0: "ACGTACG", 1: "TT"}


def test_back_splices(spark):
    cols = "chrom string, donor long, strand string, acceptor_chrom string, acceptor long, acceptor_strand string, kind int, donor_start long, acceptor_start long, name string"
    rows = [("c", 900, "+", "c", 100, "+", 0, 950, 130, "a"), ("c", 100, "+", "c", 900, "+", 0, 90, 930, "b"), ("c", 100, "-", "c", 900, "-", 1, 80, 930, "m"), ("c", 90000, "+", "c", 100, "+", 0, 90050, 130, "far"), ("c", 900, "+", "d", 100, "+", 0, 950, 130, "x")]
    got = {r.name: (r.initial, r.final) for r in tools.back_splices(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (100, 950), "m": (80, 930)}


def test_divided_ignores_nulls(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r.h for r in rows.select(tools.divided(rows, ["a", "b"], 0.5, "mean").alias("h")).collect()] == [True, None]
