"""Scans and writers of text formats on small files, cut into several splits."""

import gzip

import pytest

from methylake.operators import coverage, genome
from methylake.sources import reports, sinks, text


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(path, body):
    with open(path, "w", newline="") as f:
        f.write(body)
    return str(path)


def test_numbered_lines_across_splits(spark, tmp_path, small_splits):
    body = [f"line {i * i}" for i in range(300)]
    p, q = put(tmp_path / "a.txt", "\n".join(body) + "\n"), put(tmp_path / "b.txt", "x\n")
    rows = text.numbered(spark, [p, q]).collect()
    assert text.lines(spark, p).select("block").distinct().count() > 5
    assert [r["value"] for r in sorted((r for r in rows if r["file"].endswith("a.txt")), key=lambda r: r["ord"])] == body
    assert sorted(r["ord"] for r in rows if r["file"].endswith("a.txt")) == list(range(300))


def test_fastq(spark, tmp_path, small_splits):
    p = put(tmp_path / "r.fq", "".join(f"@r{i} x\nACGT\n+\nII#I\n" for i in range(40)) + "@cut\nAC\n")
    rows = text.fastq(spark, p).orderBy("ord").collect()
    assert [(r["id"], r["seq"], r["qual"]) for r in rows] == [(f"r{i} x", "ACGT", "II#I") for i in range(40)]
    sinks.write_fastq(text.fastq(spark, p).orderBy("ord"), str(tmp_path / "out"))
    assert text.fastq(spark, str(tmp_path / "out")).count() == 40
    with pytest.raises(Exception, match="not FASTQ"):
        text.fastq(spark, put(tmp_path / "bad.fq", ">r\nA\n+\nI\n")).collect()


def test_fasta_reads(spark, tmp_path):
    rows = text.fasta_reads(spark, put(tmp_path / "r.fa", ">a\nACG\n>b\nT\n>c\n")).orderBy("ord").collect()
    assert [(r["id"], r["seq"], r["qual"]) for r in rows] == [("a", "ACG", "III"), ("b", "T", "I")]


def test_genome(spark, tmp_path, small_splits):
    put(tmp_path / "B.fa", ">one first\r\n" + "acgtN\r\n" * 60 + ">two\n\n" + "GG\n" * 50)
    put(tmp_path / "a.fa", ">three\nAC\n>empty\n")
    put(tmp_path / "c.fasta", ">never\nA\n")
    put(tmp_path / text.SKIPPED_GENOME, ">never\nA\n")
    files = text.genome_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.fa", "B.fa"]
    assert {r["chr"]: r["seq"] for r in text.genome(spark, files).collect()} == {"one": "ACGTN" * 60, "two": "GG" * 50, "three": "AC", "empty": ""}
    with pytest.raises(Exception, match="twice"):
        text.genome(spark, put(tmp_path / "d.txt", ">x\nA\n>x\nC\n")).collect()


def test_genome_stretches(spark, tmp_path, small_splits):
    seqs = {"one": "ACGTNCCGGATCGCAGCTTAGCAC" * 40, "two": "GCATGCCGT" * 9 + "C", "tiny": "G", "three": "AC"}
    body = ">one x\n" + "\n".join(seqs["one"][i : i + 7].lower() for i in range(0, len(seqs["one"]), 7)) + "\n>two\n\n" + seqs["two"] + "\n>empty\n>tiny\nG\n>three\nA\nC\n"
    p = put(tmp_path / "g.fa", body)
    whole = spark.createDataFrame(list(seqs.items()), "chr string, seq string")
    for size in (64, 128, 4096):
        rows = text.genome_stretches(spark, p, size)
        got = rows.orderBy("chr", "start").collect()
        assert {r.chr: (r.chr_len, r.tail) for r in got} == {c: (len(s), s[-2:]) for c, s in seqs.items()}
        for r in got:
            s = seqs[r.chr]
            assert (r.left, r.seq, r.right) == (s[max(r.start - 6, 0) : r.start], s[r.start : r.start + size], s[r.start + size : r.start + size + 6])
        assert sorted(genome.cytosine_positions(rows, ffs=True).collect()) == sorted(genome.cytosine_positions(whole, ffs=True).collect())
        assert sorted(genome.drach_sites(rows).collect()) == sorted(genome.drach_sites(whole).collect())
        assert sorted(genome.composition(rows).collect()) == sorted(genome.composition(whole).collect())
        assert sorted(genome.chromosomes(rows).collect()) == sorted(genome.chromosomes(whole).collect())
    with pytest.raises(Exception, match="twice"):
        text.genome_stretches(spark, put(tmp_path / "d.txt", ">x\nA\n>x\nC\n")).collect()


SAM = "@HD\tVN:1.0\n@PG\tID:Aligner\tCL:run -1 a -2 b\n" + "r1\t99\tchr1\t10\t42\t4M\t=\t20\t14\tACGT\tIIII\tNM:i:1\tXM:Z:.Z..\tXR:Z:CT\tXG:Z:CT\n" + "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"


def test_sam(spark, tmp_path):
    p = put(tmp_path / "a.sam", SAM)
    (r,) = text.sam(spark, p).collect()
    assert (r["qname"], r["flag"], r["chr"], r["pos"], r["nm"], r["xm"], r["xr"], r["cb"], r["ord"]) == ("r1", 99, "chr1", 10, 1, ".Z..", "CT", None, 2)
    assert text.sam(spark, p, mapped_only=False).count() == 2
    assert text.paired_end(spark, p, "Aligner") is True
    assert text.paired_end(spark, p, "Other") is None
    sinks.write_sam(text.sam(spark, p, mapped_only=False).coalesce(1).orderBy("ord"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == SAM.splitlines()[2:]
    with pytest.raises(Exception, match="wrong length"):
        text.sam(spark, put(tmp_path / "b.sam", SAM.replace(".Z..", ".Z."))).collect()


def test_calls_and_coverage(spark, tmp_path):
    put(tmp_path / "CpG_OT_s.txt", "a header line\nr1\t+\tchr1\t5\tZ\nr2\t-\tchr1\t5\tz\n")
    put(tmp_path / "CHH_OB_s.txt", "a header line\nr1\t+\tchr1\t9\tH\n")
    rows = text.calls(spark, str(tmp_path / "*.txt")).orderBy("read_id").collect()
    assert [(r["ctx"], r["strand"], r["read_id"], r["pos"], r["call"]) for r in rows] == [("CpG", "OT", "r1", 5, "Z"), ("CpG", "OT", "r2", 5, "z")]
    assert text.calls(spark, str(tmp_path / "*.txt"), prefix="").count() == 3
    with pytest.raises(Exception, match="bad position"):
        text.calls(spark, put(tmp_path / "CpG_OB_s.txt", "r1\t+\tchr1\t0\tZ\n")).collect()
    p = put(tmp_path / "y.yacht", "header\nr1\t+\tchr1\t5\tZ\t1\t9\t+\nr1\t+\tchr1\tbad\tZ\t1\t9\t+\n")
    assert [(r["pos"], r["read_start"], r["orient"]) for r in text.read_calls(spark, p).collect()] == [(5, 1, "+")]
    with gzip.open(tmp_path / "s.cov.gz", "wt") as f:
        f.write("chr1\t5\t5\t50\t1\t1\n\nchr1\t7\t7\t100\t2\t0\r\n")
    got = text.coverage(spark, str(tmp_path / "s.cov.gz"))
    assert sorted(map(tuple, got.collect())) == [("chr1", 5, 1, 1), ("chr1", 7, 2, 0)]


def test_coverage_files(spark, tmp_path):
    cov = spark.createDataFrame([("b", 7, 1, 1), ("a", 30, 2, 0), ("a", 4, 0, 3), ("GL|1", 10, 1, 2)], "chr string, pos long, m long, u long").repartition(3)
    for zero in (False, True):
        path = str(tmp_path / ("c" if zero else "c.gz"))
        sinks.write_coverage(cov, path, zero_based=zero)
        with (open if zero else gzip.open)(path, "rt") as f:
            assert f.read() == f"GL|1\t{10 - zero}\t10\t33.3333333333333\t1\t2\na\t{4 - zero}\t4\t0\t0\t3\na\t{30 - zero}\t30\t100\t2\t0\nb\t{7 - zero}\t7\t50\t1\t1\n"
        assert text.coverage(spark, path).count() == 4
    sinks.write_bedgraph(cov, str(tmp_path / "b.gz"))
    with gzip.open(tmp_path / "b.gz", "rt") as f:
        assert f.read() == "track type=bedGraph\nGL|1\t9\t10\t33.3333333333333\na\t3\t4\t0\na\t29\t30\t100\nb\t6\t7\t50\n"
    owners = spark.createDataFrame([("b", "CpG_A"), ("a", "CpG_B"), ("GL|1", "CpG_A")], "chr string, file string")
    assert [r.chr for r in coverage.ordered(cov, owners).select("chr").collect()] == ["GL|1", "b", "a", "a"]


def test_split_files(spark, tmp_path):
    rows = [("r1", "OT", "1", 5, "CpG", True, "Z"), ("r1", "OT", "1", 9, "CHH", False, "h"), ("r2", "OB", "1", 3, "CHG", True, "X"), ("r3", "OT", "2", 4, "CpG", False, "z")]
    calls = spark.createDataFrame(rows, "id string, strand string, chr string, pos long, ctx string, methylated boolean, call string").repartition(3)
    d = str(tmp_path)
    assert sinks.write_calls(calls, d, "s", header="head\n") == ["CHG_OB_s.txt", "CHH_OT_s.txt", "CpG_OT_s.txt"]
    assert open(tmp_path / "CpG_OT_s.txt").read() == "head\nr1\t+\t1\t5\tZ\nr3\t-\t2\t4\tz\n"
    assert sinks.write_calls(calls, d, "s", comprehensive=True, merge_non_cpg=True, gzip=True) == ["CpG_context_s.txt.gz", "Non_CpG_context_s.txt.gz"]
    assert gzip.open(tmp_path / "Non_CpG_context_s.txt.gz", "rt").read() == "r1\t-\t1\t9\th\nr2\t+\t1\t3\tX\n"
    assert sinks.write_calls(calls, d, "s", merge_non_cpg=True) == ["CpG_OT_s.txt", "Non_CpG_OB_s.txt", "Non_CpG_OT_s.txt"]
    assert text.calls(spark, str(tmp_path / "CpG_OT_s.txt")).count() == 2
    report = spark.createDataFrame([("chr/1", 5, "+", 1, 0, "CG", "CGA"), ("b", 2, "-", 0, 0, "CG", "CGT"), ("b", 1, "+", 0, 2, "CG", "CGA")], "chr string, pos long, strand string, m long, u long, context string, tri string")
    assert sinks.write_report(report.where("chr = 'b'"), d, "x", by_chromosome=True) == ["x.chrb.CpG_report.txt"]
    assert open(tmp_path / "x.chrb.CpG_report.txt").read() == "b\t1\t+\t0\t2\tCG\tCGA\nb\t2\t-\t0\t0\tCG\tCGT\n"
    assert sinks.write_report(report, d, "x", cx=True, gzip=True) == ["x.CX_report.txt.gz"]
    assert gzip.open(tmp_path / "x.CX_report.txt.gz", "rt").read().startswith("b\t1\t+")
    merged = spark.createDataFrame([("b", 3, 4, 100 / 3, 1, 2)], "chr string, start long, end long, pct double, m long, u long")
    sinks.write_merged_cpgs(merged, str(tmp_path / "m.cov"), zero_based=True)
    assert open(tmp_path / "m.cov").read() == "b\t2\t4\t33.333333\t1\t2\n"


def test_sam_files(spark, tmp_path):
    records = text.sam(spark, put(tmp_path / "a.sam", SAM), mapped_only=False).coalesce(1).orderBy("ord")
    sinks.write_sam_file(records, str(tmp_path / "o.sam"), [("chr1", 50)], "ID:x")
    assert open(tmp_path / "o.sam").read() == "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:chr1\tLN:50\n@PG\tID:x\n" + "\n".join(SAM.splitlines()[2:]) + "\n"
    buckets = spark.createDataFrame([("r1", "all_meth"), ("r2", "discarded")], "id string, bucket string")
    assert sinks.write_buckets(records, buckets, str(tmp_path), [("chr1", 50)]) == ["all_meth.sam"]
    assert open(tmp_path / "all_meth.sam").read().splitlines()[2].startswith("r1\t99")


ALIGNMENT = """Sequences analysed in total:\t100
Number of alignments with a unique best hit from the different alignments:\t70
Sequences with no alignments under any condition:\t20
Sequences did not map uniquely:\t10
Sequences which were discarded because genomic sequence could not be extracted:\t0
Total number of C's analysed:\t500
Total methylated C's in CpG context:\t30
Total methylated C's in CHG context:\t2
Total methylated C's in CHH context:\t3
Total unmethylated C's in CpG context:\t10
Total unmethylated C's in CHG context:\t20
Total unmethylated C's in CHH context:\t30
"""


def test_reports(spark, tmp_path):
    from pyspark.sql import functions as F

    put(tmp_path / "one.aln", ALIGNMENT)
    put(tmp_path / "two.aln", ALIGNMENT.replace("\t500", "\t500 or so").replace("C's in CHH context:\t3\n", "C's in CHH context:\t0\n").replace("CHH context:\t30", "CHH context:\t0"))
    put(tmp_path / "one.ded", reports.dedup_text("one.bam", 70, 5, 4, umi=True))
    put(tmp_path / "one.spl", "Total number of C's analysed:\t400\nTotal methylated C's in CpG context:\t25\nTotal C to T conversions in CpG context:\t9\n")
    named = lambda df: df.withColumn("sample", F.regexp_extract("file", r"([a-z]+)\.[a-z]+$", 1))
    parts = [named(f(spark, str(tmp_path / p))) for f, p in ((reports.alignment_reports, "*.aln"), (reports.dedup_reports, "*.ded"), (reports.splitting_reports, "*.spl"))]
    summary = reports.sample_summary(*parts)
    want = "\t".join(reports.SUMMARY.values()) + "\none\t100\t70\t20\t10\t0\t5\t65\t400\t25\t9\t2\t20\t3\t30\ntwo\t100\t70\t20\t10\t0\t\t\t\t30\t10\t2\t20\t0\t0\n"
    assert reports.summary_text(summary) == want
    assert {r.sample for r in reports.plotted(summary).collect()} == {"one"}
    both = reports.merge_counts(parts[0].select("sample", "total_reads", "aligned").withColumn("sample", F.lit("all")), "sample").first()
    assert tuple(both) == ("all", 200, 140)


def test_report_texts(spark):
    table = spark.createDataFrame([(1, c, p, 1, 2, 100 / 3) if p == 1 else (1, c, p, 0, 0, None) for c in ("CpG", "CHG", "CHH") for p in (1, 2)], "read int, ctx string, position int, m long, u long, pct double")
    one = "===========\nposition\tcount methylated\tcount unmethylated\t% methylation\tcoverage\n1\t1\t2\t33.33\t3\n2\t0\t0\t\t0\n\n"
    assert reports.mbias_text(table) == "".join(f"{c} context\n{one}" for c in ("CpG", "CHG", "CHH"))
    whole = spark.createDataFrame([("1", "AACAGATCCGCTGGTTA")], "chr string, seq string")
    body = reports.composition_text(genome.composition_report(genome.composition(whole), genome.composition(whole)), "head").splitlines()
    assert body[0] == "head" and body[1] == "A\t5\t29.41\t5\t29.41\t1.000" and len(body) == 21
    with pytest.raises(ZeroDivisionError):
        reports.composition_text(genome.composition_report(genome.composition(whole), genome.composition(whole.where("chr = '2'"))), "head")
    assert "66.67%" in reports.consistency_text({"all_meth": 2, "discarded": 1, "skipped": 9}) and "N/A" in reports.consistency_text({})
    assert reports.splitting_share("CHG", 1, 2).endswith("33.3%") and "Can't" in reports.splitting_share("CHG", 0, 0)


def test_kinds_of_alignments(spark, tmp_path):
    from methylake.sources import alignments, bam

    p = put(tmp_path / "a.x", SAM)
    assert alignments.kind(spark, p) == "sam"
    records = alignments.read(spark, p, mapped_only=False)
    done = bam.write_bam(records.drop("file", "ord").coalesce(1), str(tmp_path / "b"), [("chr1", 50)]).first()
    path = f"{tmp_path}/b/{done[0].rsplit('/', 1)[-1]}"
    assert alignments.kind(spark, path) == "bam" and alignments.read(spark, path).count() == 1
    with pytest.raises(ValueError, match="CRAM"):
        alignments.read(spark, put(tmp_path / "c.x", "CRAM\x03"))
    assert text.chromosome_names(spark, put(tmp_path / "s.sam", "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:b\tLN:5\n@SQ\tSN:a\tLN:6\n")) == ["b", "a"]
    text.reject_sorted(spark, str(tmp_path / "s.sam"), False)
    with pytest.raises(ValueError, match="sorted"):
        text.reject_sorted(spark, str(tmp_path / "s.sam"), True)


def test_cached_composition(spark, tmp_path):
    whole = spark.createDataFrame([("1", "AACAGATCCGCTGGTTA")], "chr string, seq string")
    first = sorted(reports.cached_composition(whole, str(tmp_path / "c")).collect())
    assert first == sorted(genome.composition(whole).collect())
    assert sorted(reports.cached_composition(whole.limit(0), str(tmp_path / "c")).collect()) == first
    put(tmp_path / "CpG_OT_h.txt", "r1\t+\tchr1\t5\tZ\nr2\t+\tchr1\t6\tZ\n")
    assert (text.calls(spark, str(tmp_path / "CpG*"), no_header=False).count(), text.calls(spark, str(tmp_path / "CpG*")).count()) == (1, 2)
