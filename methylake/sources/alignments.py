"""Alignments whatever their format: the kind of a file is told from its first bytes, not from its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methylake.sources import bam, text

# The first bytes of the formats.
GZIP, CRAM = b"\x1f\x8b", b"CRAM"


def kind(spark: SparkSession, path: str) -> str:
    """bam, cram or sam; a gzip file is BAM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        first = bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)
    finally:
        stream.close()
    return "bam" if first.startswith(GZIP) else "cram" if first.startswith(CRAM) else "sam"


def read(spark: SparkSession, path: str, mapped_only: bool = True) -> DataFrame:
    """The records of a BAM or SAM file, with the columns of text.sam(); CRAM is refused."""
    found = kind(spark, path)
    if found == "cram":
        raise ValueError(f"{path} is CRAM, which can't be read; turn it into BAM")
    return bam.bam(spark, path, mapped_only=mapped_only) if found == "bam" else text.sam(spark, path, mapped_only)
