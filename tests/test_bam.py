"""BAM files written by several tasks and read back in small splits."""

import random

import pytest

from methylake.sources.bam import bam, bam_reads, paired_reads, write_bam

CHROMOSOMES = [("chr1", 1_000_000), ("chr2", 500_000)]


def rows(n):
    r = random.Random(5)
    out = []
    for i in range(n):
        size = r.choice([1, 7, 50, 151, 3000])
        seq = "".join(r.choices("ACGTN", k=size))
        qual = "*" if i % 11 == 0 else "".join(chr(33 + r.randrange(41)) for _ in range(size))
        cigar = f"{size}M" if size < 20 else f"5S{size - 15}M2D10M"
        chrom, mate = r.choice(["chr1", "chr2"]), r.choice(["*", "=", "chr1"])
        mate = "=" if mate == chrom else mate
        xm = "".join(r.choices("zZxXhH.", k=size))
        out.append((f"read{i}", r.choice([0, 16, 99]), chrom, r.randrange(1, 400_000), 42, cigar, mate, 0 if mate == "*" else 77, -3, seq, qual, i % 300, "5A3", xm, "CT", "GA", None, "AC" if i % 2 else None, None))
    out.append(("lost", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "III", None, *[None] * 7))
    return out


NAMES = "qname flag chr pos mapq cigar rnext pnext tlen seq qual nm md xm xr xg rx cb ur".split()
TYPES = "qname string, flag int, chr string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, nm int, md string, xm string, xr string, xg string, rx string, cb string, ur string"


@pytest.mark.parametrize("split", [4_000, 70_000, 64 << 20])
def test_round_trip(spark, tmp_path, split):
    data = rows(3000)
    done = write_bam(spark.createDataFrame(data, TYPES).repartition(2), str(tmp_path / "x"), CHROMOSOMES).collect()
    assert sum(r.records for r in done) == len(data) and len(done) == 2
    got = bam(spark, str(tmp_path / "x"), mapped_only=False, split=split)
    assert sorted(map(str, (tuple(r) for r in got.select(*NAMES).collect()))) == sorted(map(str, data))
    assert got.select("file", "ord").distinct().count() == len(data)
    assert bam(spark, str(tmp_path / "x"), split=split).count() == len(data) - 1


def test_order_and_empty(spark, tmp_path):
    data = rows(500)
    write_bam(spark.createDataFrame(data, TYPES).coalesce(1), str(tmp_path / "x"), CHROMOSOMES).collect()
    got = bam(spark, str(tmp_path / "x"), mapped_only=False, split=4_000).orderBy("ord").select("qname").collect()
    assert [r.qname for r in got] == [d[0] for d in data]
    write_bam(spark.createDataFrame([], TYPES).coalesce(1), str(tmp_path / "none"), CHROMOSOMES).collect()
    assert bam(spark, str(tmp_path / "none")).count() == 0


def test_missing_call_string_raises(spark, tmp_path):
    data = [("r", 0, "chr1", 5, 1, "3M", "*", 0, 0, "ACG", "III", None, None, None, "CT", "CT", None, None, None)]
    write_bam(spark.createDataFrame(data, TYPES), str(tmp_path / "x"), CHROMOSOMES).collect()
    assert bam(spark, str(tmp_path / "x"), mapped_only=False).count() == 1
    with pytest.raises(Exception, match="XM, XR or XG missing"):
        bam(spark, str(tmp_path / "x")).collect()


def test_reads(spark, tmp_path):
    rest = ("*", 0, 0, "*", "*", 0, 0)
    tags = (None,) * 8
    data = [("a", 77, *rest, "ACGR", "IIH!", *tags), ("a", 141 | 16, *rest, "ACGR", "IIH!", *tags), ("b", 4, *rest, "ACG", "*", *tags), ("c", 256, *rest, "ACG", "III", *tags), ("d", 2048, *rest, "ACG", "III", *tags), ("e", 4, *rest, "*", "*", *tags)]
    write_bam(spark.createDataFrame(data, TYPES).coalesce(1), str(tmp_path / "x"), CHROMOSOMES).collect()
    records = bam(spark, str(tmp_path / "x"), mapped_only=False)
    got = [tuple(r) for r in bam_reads(records).orderBy("ord").select("id", "mate", "seq", "qual").collect()]
    assert got == [("a", 1, "ACGR", "IIH!"), ("a", 2, "YCGT", "!HII"), ("b", None, "ACG", "BBB"), ("e", None, "", "")]
    assert [r.paired for r in paired_reads(records).collect()] == [True]
